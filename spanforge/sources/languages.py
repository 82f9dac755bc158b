"""Languages by file extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Extensions of each language, and how many kinds of syntax define, import and call in its grammar;
# languages without any are indexed as whole files.
LANGUAGES = """
python .py 2 2 1
javascript .js,.jsx 3 1 1
typescript .ts,.tsx 3 1 1
go .go 3 2 1
rust .rs 6 1 2
cpp .cpp,.cc,.c,.h,.hpp 4 1 1
java .java 4 1 1
c_sharp .cs 5 1 1
ruby .rb 4 1 2
php .php 3 1 2
swift .swift 5 1 1
kotlin .kt,.kts 3 1 1
scala .scala 4 1 1
lua .lua 2 0 1
elixir .ex,.exs 1 0 0
haskell .hs 4 1 0
ocaml .ml,.mli 3 0 0
bash .sh,.bash 1 0 1
html .html,.htm 0 0 0
css .css 0 0 0
yaml .yaml,.yml 0 0 0
toml .toml 0 0 0
json .json 0 0 0
sql .sql 0 0 0
zig .zig 1 0 1
dart .dart 3 1 1
""".strip()
#: Indexed as whole files only.
PLAIN = (".md",)


def registry(text: str = LANGUAGES) -> dict[str, str]:
    """Extension to language; add a line to the text to add a language."""
    return {e: line.split()[0] for line in text.splitlines() for e in line.split()[1].split(",")}


def supported(text: str = LANGUAGES) -> list[str]:
    return [*registry(text), *PLAIN]


def languages(spark: SparkSession, text: str = LANGUAGES) -> DataFrame:
    rows = [(n, e, int(d), int(i), int(c)) for n, es, d, i, c in (line.split() for line in text.splitlines()) for e in es.split(",")]
    return spark.createDataFrame(rows, "language string, extension string, definitions int, imports int, calls int")
