"""File types: names for lists of globs, selection and negation, additions and removals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlode.functions.globs import GlobOptions, matches

#: The file name patterns of common types. More are added with `add` or read with `from_text`.
DEFAULTS: dict[str, tuple[str, ...]] = {
    "aidl": ("*.aidl",),
    "asciidoc": ("*.adoc", "*.asc", "*.asciidoc"),
    "awk": ("*.awk",),
    "bat": ("*.bat",),
    "batch": ("*.bat",),
    "c": ("*.[chH]", "*.[chH].in", "*.cats"),
    "cabal": ("*.cabal",),
    "carp": ("*.carp",),
    "cbor": ("*.cbor",),
    "ceylon": ("*.ceylon",),
    "clojure": ("*.clj", "*.cljc", "*.cljs", "*.cljx"),
    "cmake": ("*.cmake", "CMakeLists.txt"),
    "cml": ("*.cml",),
    "config": ("*.cfg", "*.conf", "*.config", "*.ini"),
    "cpp": ("*.[ChH]", "*.cc", "*.[ch]pp", "*.[ch]xx", "*.hh", "*.inl", "*.[ChH].in", "*.cc.in", "*.[ch]pp.in", "*.[ch]xx.in", "*.hh.in"),
    "creole": ("*.creole",),
    "cs": ("*.cs",),
    "cshtml": ("*.cshtml",),
    "csproj": ("*.csproj",),
    "css": ("*.css", "*.scss"),
    "csv": ("*.csv",),
    "d": ("*.d",),
    "dart": ("*.dart",),
    "dhall": ("*.dhall",),
    "docker": ("*Dockerfile*",),
    "edn": ("*.edn",),
    "elixir": ("*.ex", "*.eex", "*.exs", "*.heex", "*.leex", "*.livemd"),
    "elm": ("*.elm",),
    "erb": ("*.erb",),
    "erlang": ("*.erl", "*.hrl"),
    "fidl": ("*.fidl",),
    "fish": ("*.fish",),
    "fut": ("*.fut",),
    "gleam": ("*.gleam",),
    "go": ("*.go",),
    "haml": ("*.haml",),
    "haskell": ("*.hs", "*.lhs", "*.cpphs", "*.c2hs", "*.hsc"),
    "hbs": ("*.hbs",),
    "html": ("*.htm", "*.html", "*.ejs"),
    "hy": ("*.hy",),
    "janet": ("*.janet",),
    "java": ("*.java", "*.jsp", "*.jspx", "*.properties"),
    "jl": ("*.jl",),
    "js": ("*.js", "*.jsx", "*.vue", "*.cjs", "*.mjs"),
    "json": ("*.json", "composer.lock", "*.sarif"),
    "jsonl": ("*.jsonl",),
    "k": ("*.k",),
    "kotlin": ("*.kt", "*.kts"),
    "lean": ("*.lean",),
    "less": ("*.less",),
    "license": ("COPYING", "COPYING[.-]*", "COPYRIGHT", "COPYRIGHT[.-]*", "EULA", "EULA[.-]*", "LICEN[CS]E", "LICEN[CS]E[.-]*", "NOTICE", "NOTICE[.-]*", "PATENTS", "PATENTS[.-]*", "UNLICEN[CS]E", "UNLICEN[CS]E[.-]*", "AGPL-*[0-9]*", "APACHE-*[0-9]*", "BSD-*[0-9]*", "GFDL-*[0-9]*", "GNU-*[0-9]*", "GPL-*[0-9]*", "LGPL-*[0-9]*", "MIT-*[0-9]*", "MPL-*[0-9]*", "OFL-*[0-9]*", "licen[cs]e", "licen[cs]e.*", "*[.-]LICEN[CS]E*", "agpl[.-]*", "gpl[.-]*", "lgpl[.-]*", "CC-BY-*"),
    "log": ("*.log",),
    "lua": ("*.lua",),
    "lz4": ("*.lz4",),
    "lzma": ("*.lzma",),
    "make": ("[Gg][Nn][Uu]makefile", "[Mm]akefile", "[Gg][Nn][Uu]makefile.am", "[Mm]akefile.am", "[Gg][Nn][Uu]makefile.in", "[Mm]akefile.in", "Makefile.*", "*.mk", "*.mak"),
    "markdown": ("*.markdown", "*.md", "*.mdown", "*.mdwn", "*.mkd", "*.mkdn", "*.mdx"),
    "md": ("*.markdown", "*.md", "*.mdown", "*.mdwn", "*.mkd", "*.mkdn", "*.mdx"),
    "mint": ("*.mint",),
    "ml": ("*.ml",),
    "nix": ("*.nix",),
    "pdf": ("*.pdf",),
    "perl": ("*.perl", "*.pl", "*.PL", "*.plh", "*.plx", "*.pm", "*.t"),
    "php": ("*.php", "*.php3", "*.php4", "*.php5", "*.php7", "*.php8", "*.pht", "*.phtml"),
    "po": ("*.po",),
    "pod": ("*.pod",),
    "protobuf": ("*.proto",),
    "purs": ("*.purs",),
    "py": ("*.py", "*.pyi"),
    "python": ("*.py", "*.pyi"),
    "qml": ("*.qml",),
    "qrc": ("*.qrc",),
    "r": ("*.R", "*.r", "*.Rmd", "*.rmd", "*.Rnw", "*.rnw"),
    "rdoc": ("*.rdoc",),
    "robot": ("*.robot",),
    "rst": ("*.rst",),
    "ruby": ("config.ru", "Gemfile", ".irbrc", "Rakefile", "*.gemspec", "*.rb", "*.rbw", "*.rake"),
    "rust": ("*.rs",),
    "scala": ("*.scala", "*.sbt"),
    "sh": (".profile", "profile", ".bash_login", "bash_login", ".bash_logout", "bash_logout", ".bash_profile", "bash_profile", ".bashrc", "bashrc", ".zshenv", "zshenv", ".zlogin", "zlogin", ".zlogout", "zlogout", ".zprofile", "zprofile", ".zshrc", "zshrc", ".env", ".login", ".logout", ".cshrc", "*.cshrc", ".kshrc", "*.kshrc", ".tcshrc", "*.bashrc", "*.bash", "*.csh", "*.env", "*.ksh", "*.sh", "*.tcsh", "*.zsh"),
    "soy": ("*.soy",),
    "spark": ("*.spark",),
    "spec": ("*.spec",),
    "sql": ("*.sql", "*.psql"),
    "ssa": ("*.ssa",),
    "svg": ("*.svg",),
    "swift": ("*.swift",),
    "taskpaper": ("*.taskpaper",),
    "tcl": ("*.tcl",),
    "tex": ("*.tex", "*.ltx", "*.cls", "*.sty", "*.bib", "*.dtx", "*.ins"),
    "textile": ("*.textile",),
    "thrift": ("*.thrift",),
    "toml": ("*.toml", "Cargo.lock"),
    "ts": ("*.ts", "*.tsx", "*.cts", "*.mts"),
    "twig": ("*.twig",),
    "txt": ("*.txt",),
    "typescript": ("*.ts", "*.tsx", "*.cts", "*.mts"),
    "vala": ("*.vala",),
    "vb": ("*.vb",),
    "vcl": ("*.vcl",),
    "vue": ("*.vue",),
    "wgsl": ("*.wgsl",),
    "xml": ("*.xml", "*.xml.dist", "*.dtd", "*.xsl", "*.xslt", "*.xsd", "*.xjb", "*.rng", "*.sch", "*.xhtml"),
    "yaml": ("*.yaml", "*.yml"),
    "yang": ("*.yang",),
    "zig": ("*.zig",),
}


class FileTypes:
    """Definitions that can be changed, and the selection over them."""

    def __init__(self, definitions: dict[str, tuple[str, ...]] | None = None) -> None:
        self.globs = {k: list(v) for k, v in (DEFAULTS if definitions is None else definitions).items()}

    @classmethod
    def from_text(cls, text: str) -> FileTypes:
        """Types from lines `name:glob`, for tables that are kept elsewhere."""
        out = cls({})
        for line in text.splitlines():
            if line.strip() and not line.startswith("#"):
                out.add(line.strip())
        return out

    def add(self, definition: str) -> FileTypes:
        """`name:glob` or `name:include:other,another`."""
        name, _, rest = definition.partition(":")
        if not name or not rest or not name.isalnum() or name == "all":
            raise ValueError(f"invalid type definition {definition!r}")
        if rest.startswith("include:"):
            for other in rest[8:].split(","):
                if other not in self.globs:
                    raise ValueError(f"unknown type {other!r}")
                self.globs.setdefault(name, []).extend(self.globs[other])
        else:
            self.globs.setdefault(name, []).append(rest)
        return self

    def clear(self, name: str) -> FileTypes:
        self.globs.pop(name, None)
        return self

    def of(self, name: str) -> list[str]:
        if name == "all":
            return sorted({g for v in self.globs.values() for g in v})
        if name not in self.globs:
            raise ValueError(f"unknown type {name!r}")
        return self.globs[name]

    def admitted(self, path: Column, choices: list[tuple[str, bool]]) -> Column:
        """`choices`: (name, selected) in order; the last pattern that matches decides; any selection excludes the rest."""
        out = F.lit(not any(selected for _, selected in choices))
        for name, selected in choices:
            for glob in self.of(name):
                out = F.when(matches(path, glob, GlobOptions(basename=True)), F.lit(selected)).otherwise(out)
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        """(name, globs) as one line a type."""
        rows = spark.createDataFrame([(n, g) for n, v in self.globs.items() for g in v], "name string, glob string")
        return rows.groupBy("name").agg(F.array_join(F.sort_array(F.collect_set("glob")), ", ").alias("globs"))
