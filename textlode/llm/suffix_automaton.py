"""Suffix automata over sequences of word numbers, for one sequence or several.

A state stands for the substrings that end at the same places; `length` is that of the longest, `link` leads to the state
of the longest suffix that ends at more places, `first_end` is the last place of the first occurrence. Both the states and
the transitions are linear in the number of words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator


class SuffixAutomaton:
    """All substrings of the sequences that were added; no substring reaches from one sequence into the next."""

    def __init__(self) -> None:
        self.length, self.link, self.first_end = [0], [-1], [-1]
        self.after: list[dict[int, int]] = [{}]
        #: How often, by weight, the longest string of a state was the prefix of an added sequence.
        self.weight = [0]
        self.size = 0

    def add(self, sequence: Iterable[int], weight: int = 1) -> None:
        length, link, first_end, after, weights = self.length, self.link, self.first_end, self.after, self.weight
        last, place = 0, self.size
        for word in sequence:
            known = after[last].get(word)
            if known is not None and length[known] == length[last] + 1:  # another sequence began like this
                last = known
            elif known is not None:
                last = self._clone(last, known, word)
            else:
                new = len(length)
                length.append(length[last] + 1)
                link.append(0)
                first_end.append(place)
                after.append({})
                weights.append(0)
                at = last
                while at >= 0:
                    ways = after[at]
                    if word in ways:
                        break
                    ways[word] = new
                    at = link[at]
                if at >= 0:
                    known = after[at][word]
                    link[new] = known if length[known] == length[at] + 1 else self._clone(at, known, word)
                last = new
            weights[last] += weight
            place += 1
        self.size = place

    def _clone(self, at: int, known: int, word: int) -> int:
        """Split off the strings of `known` that are at most one word longer than those of `at`."""
        length, link, after = self.length, self.link, self.after
        new = len(length)
        length.append(length[at] + 1)
        link.append(link[known])
        self.first_end.append(self.first_end[known])
        after.append(after[known].copy())
        self.weight.append(0)
        link[known] = new
        while at >= 0 and after[at].get(word) == known:
            after[at][word] = new
            at = link[at]
        return new

    def occurrences(self) -> list[int]:
        """By state, the weight of the places at which its strings end."""
        total, link = self.weight.copy(), self.link
        for state in sorted(range(1, len(total)), key=self.length.__getitem__, reverse=True):
            total[link[state]] += total[state]
        return total

    def repeated_suffix(self, least: int = 2) -> list[int]:
        """By state, the length of the longest suffix of its strings that occurs `least` times or more (whole states only)."""
        total, link, length = self.occurrences(), self.link, self.length
        out = [0] * len(total)
        for state in sorted(range(1, len(total)), key=length.__getitem__):
            out[state] = length[state] if total[state] >= least else out[link[state]]
        return out

    def matching_statistics(self, sequence: Iterable[int], repeated: list[int]) -> Iterator[int]:
        """At each word, the length of the longest suffix read so far that occurs here as often as `repeated` asks."""
        length, link, after = self.length, self.link, self.after
        state = size = 0
        for word in sequence:
            to = after[state].get(word)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = after[state].get(word)
            if to is not None:
                state = to
                size += 1
            # strings of one state occur equally often, so that only the length read can be below the state's own
            yield min(size, repeated[state])
