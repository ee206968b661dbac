"""Secret scan: candidates by pattern, false positives removed by a random forest.

Candidates are assignments to telling names, tokens of known formats and long unbroken strings.  Each gets numeric features: its length, shares of character
classes and of the transitions between them, how much of it dictionary words and placeholder words cover, the path it comes from, and the five words on
either side.  The forest is trained by Spark ML on labelled findings (``labelled_findings`` makes ``LABELLED`` of them by rule; any table with the same
columns can take its place), and then becomes one SQL expression over the leaves' class shares, equal to Spark ML's own probability, so scoring runs inside
the scan without Python and without a row per candidate.

Null and empty texts have no candidates.  Long texts are scanned whole and a value of any length is one candidate; patterns are possessive and do not recurse.
A null path has no telling name.  Rows are independent: repeated rows give equal rows, an empty table gives an empty result.  Of the input ``doc_id``,
``text`` and the path column are read; ``redact`` keeps all columns, whatever their names, and a null text stays null.
"""

from __future__ import annotations

import json
import re
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import quoted, reliable, whole_row
from .spans import located, replaced

#: Names that a secret is assigned to, and formats that issuers publish.
ASSIGNED = r"(?i:passwords?|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?)[\"']?[\x20]{0,2}[=:][\x20]{0,2}[\"']?"
FORMATS = r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_(?:live|test)_[A-Za-z0-9]{16,}+|xox[baprs]-[A-Za-z0-9-]{10,}+"
CANDIDATE = rf"{ASSIGNED}[^\x09-\x0D\x20\"',;]{{8,}}+|(?<![A-Za-z0-9])(?:{FORMATS})(?![A-Za-z0-9])|(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{32,}}+"
#: Words of placeholders, words beside look-alikes, words beside secrets, and names in paths of samples and of settings.
PLACEHOLDERS = "example placeholder password changeme change sample dummy test your insert replace default value here none null todo xxxx redacted env".split()
BENIGN = "commit sha1 sha256 md5 checksum digest revision hash uuid example sample placeholder etag build fixture integrity".split()
TELLING = "password passwd secret token key bearer authorization credential credentials auth signing private login".split()
SAMPLES = "test example sample fixture mock doc".split()
SETTINGS = "env config setting secret credential deploy prod".split()

#: A vocabulary file of a public tokenizer with word ends; its most frequent whole words are the dictionary.
VOCABULARY, DICTIONARY_WORDS = "/opt/tokenizers/word_bpe_49k.json", 8000

_SAME, _MIXED = ("aa", "AA", "00"), (("a0", "A0"), ("0a", "0A"), ("aA",), ("Aa",))
FEATURES = (
    "length", "digits", "upper", "lower", "other", "distinct", "lower_lower", "upper_upper", "digit_digit", "letter_digit", "digit_letter", "lower_upper", "upper_lower", "other_other",
    "vowel_consonant", "hex", "dictionary", "placeholder", "assigned", "format", "benign_before", "benign_after", "telling_beside", "path_sample", "path_settings",
)
LABELLED = 6000
TREES, DEPTH = 15, 7


@cache
def dictionary(path: str = VOCABULARY, most: int = DICTIONARY_WORDS) -> tuple[str, ...]:
    """The ``most`` most frequent words of four letters or more of a vocabulary; read on the driver only."""
    with open(path, encoding="utf-8") as file:
        ids = json.load(file)["model"]["vocab"]
    words = (k.removesuffix("</w>") for k, _ in sorted(ids.items(), key=lambda x: x[1]) if re.fullmatch("[a-z]{4,}</w>", k))
    return tuple(w for w, _ in zip(words, range(most)))


def _any(words: list[str]) -> str:
    return "(?:" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + ")"


def features(value: Column, name: Column, before: Column, after: Column, path: Column, words: tuple[str, ...]) -> Column:
    """array<double> in the order of FEATURES.  ``name``: the telling name and sign that the value is assigned to, or empty."""
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    share = lambda pattern: F.length(F.regexp_replace(value, pattern, "")) / n
    kinds = F.regexp_replace(value, "[^A-Za-z0-9]", "-")
    for pattern, letter in (("[a-z]", "a"), ("[B-Z]", "A"), ("[1-9]", "0")):
        kinds = F.regexp_replace(kinds, pattern, letter)
    steps = F.greatest(F.length(value) - 1, F.lit(1)).cast("double")
    count = lambda text, pair: F.regexp_count(text, F.lit(f"{pair[0]}(?={pair[1]})"))
    moves = lambda pairs: sum((count(kinds, p) for p in pairs[1:]), count(kinds, pairs[0])) / steps
    sounds = F.regexp_replace(F.regexp_replace(F.lower(value), "[aeiou]", "1"), "[a-z]", "2")
    letters = F.greatest(F.length(F.regexp_replace(value, "[^A-Za-z]", "")), F.lit(1)).cast("double")
    runs = F.regexp_extract_all(F.lower(F.regexp_replace(value, "([a-z])(?=[A-Z])", "$1 ")), F.lit("[a-z]{4,}"), F.lit(0))
    # one literal for the whole dictionary, hashed once per candidate that has letters enough
    among = F.when(F.size(runs) > 0, F.array_intersect(runs, F.split(F.lit(" ".join(words)), " "))).otherwise(runs)
    known = F.transform(F.array(among), lambda found: F.aggregate(F.filter(runs, lambda w: F.array_contains(found, w)), F.lit(0), lambda s, w: s + F.length(w)))[0]
    yes = lambda condition: F.when(condition, 1.0).otherwise(0.0)
    where = F.lower(F.coalesce(path, F.lit("")))
    made = [
        F.least(n, F.lit(200.0)),
        share("[^0-9]"),
        share("[^A-Z]"),
        share("[^a-z]"),
        share("[A-Za-z0-9]"),
        F.size(F.array_distinct(F.split(value, ""))) / F.least(n, F.lit(64.0)),
        *[moves([p]) for p in _SAME],
        *[moves(p) for p in _MIXED],
        moves(["--"]),
        (count(sounds, "12") + count(sounds, "21")) / letters,
        yes(value.rlike("^(?:[0-9a-f]++|[0-9A-F]++)$")),
        known / n,
        1 - F.length(F.regexp_replace(F.lower(value), _any(PLACEHOLDERS), "")) / n,
        yes(F.length(name) > 0),
        yes(value.rlike(f"^(?:{FORMATS})$")),
        yes(F.lower(before).rlike(_any(BENIGN))),
        yes(F.lower(after).rlike(_any(BENIGN))),
        yes(F.lower(before).rlike(_any(TELLING)) | F.lower(after).rlike(_any(TELLING))),
        yes(where.rlike(_any(SAMPLES))),
        yes(where.rlike(_any(SETTINGS))),
    ]
    return F.array(*[x.cast("double") for x in made])


def labelled_findings(spark: SparkSession, n: int = LABELLED, seed: int = 0) -> DataFrame:
    """id, value, name, before, after, path and label of ``n`` findings made by rule: secrets of several shapes and lengths, and look-alikes."""

    def q(text: str) -> str:
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def roll(k: int, most: int) -> str:  # hashes of the id stand for chance: the same findings in every run
        return f"cast(pmod(xxhash64(id, {1000 * seed + k}), {most}) as int)"

    def pick(k: int, words: list[str]) -> str:
        return f"element_at(array({','.join(map(q, words))}), {roll(k, len(words))} + 1)"

    def cut(text: str, low: int, high: int, k: int = 1) -> str:
        return f"substring({text}, 1, {low} + {roll(k, high - low + 1)})"

    def word(k: int) -> str:
        return f"element_at(plain, {roll(k, 2000)} + 1)"

    def title(k: int) -> str:
        return f"initcap({word(k)})"

    def join(*parts: str) -> str:
        return f"concat({','.join(parts)})"

    given = pick(90, ['token = "', "password=", "api_key: ", "SECRET='", "access_key = ", "pwd: ", "private_key = ", "credentials: "])
    usual = "concat_ws(' ', " + ", ".join(pick(91 + k, "the of und para une with in on la der from at ing ti re ou".split()) for k in range(3)) + ")"
    about, hint = join(usual, "' '", pick(94, BENIGN[:12]), "' '"), join(usual, "' '", pick(95, TELLING[3:9]), "' '")
    either = f"if({roll(98, 2)} = 0, {usual}, {about})"
    real = pick(96, ["src0", "src1", "src7", "app/main", "app/pay", "app/settings", "deploy/prod.env", "lib/util"])
    sample = pick(97, ["tests/fixture", "docs/guide", "example/app", "mock/data"])
    six = ", ".join(word(20 + k) for k in range(6))
    uuid = "concat_ws('-', " + ", ".join(f"substring(hexes, {a}, {b})" for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + ")"
    # value, name, before, after, path, label
    shapes = [
        (cut("hexes", 32, 128), given, usual, usual, real, 1),
        (cut("hexes", 10, 31), given, usual, usual, real, 1),
        (cut("b64", 10, 40), given, usual, usual, real, 1),
        (cut("url64", 32, 170), given, usual, usual, real, 1),
        (join("'AKIA'", cut("caps", 16, 16)), "''", usual, usual, real, 1),
        (join(pick(2, ["ghp_", "gho_", "ghs_"]), cut("b64", 36, 36)), "''", usual, usual, real, 1),
        (join(pick(2, ["sk_live_", "sk_test_"]), cut("b64", 16, 80)), "''", usual, usual, real, 1),
        (join(pick(2, ["xoxb-", "xoxp-"]), cut("hexes", 12, 60)), "''", usual, usual, real, 1),
        (cut("url64", 32, 170), "''", usual, usual, real, 1),
        (cut("b64", 32, 100), "''", hint, usual, real, 1),
        (join("'eyJ'", cut("url64", 30, 160)), "''", hint, usual, real, 1),
        (cut("hexes", 32, 64), "''", hint, usual, real, 1),
        (join(word(3), cut("hexes", 2, 4), title(4), "'!'", roll(5, 99)), given, usual, usual, real, 1),
        (join(word(6), roll(7, 9), word(8), cut("caps", 2, 3, 9), roll(10, 99)), given, usual, usual, real, 1),
        (join(cut("b64", 5, 9), pick(11, list("!@#$%&")), cut("hexes", 3, 6)), given, usual, usual, real, 1),
        (cut("caps", 12, 32), given, usual, usual, real, 1),
        (cut("hexes", 40, 40), "''", about, usual, real, 0),
        (cut("hexes", 64, 64), "''", about, usual, real, 0),
        (cut("hexes", 32, 64), "''", usual, join("' '", about), real, 0),
        (uuid, "''", either, usual, real, 0),
        (join(pick(12, PLACEHOLDERS), pick(13, PLACEHOLDERS), pick(14, ["123", "1234", "", "1"])), given, usual, usual, real, 0),
        (join("'your_'", word(15), pick(16, ["_here", "_token", "_value"])), given, usual, usual, real, 0),
        (join("'AKIA'", cut("caps", 9, 9), "'EXAMPLE'"), "''", either, usual, sample, 0),
        (f"if({roll(17, 2)} = 0, concat_ws('_', {six}), concat_ws('-', {six}))", "''", either, usual, real, 0),
        (join(word(26), *[title(27 + k) for k in range(5)]), "''", usual, usual, real, 0),
        (join("'/'", f"concat_ws('/', {six})"), "''", usual, usual, real, 0),
        (f"translate({cut('hexes', 32, 128)}, '0123456789abcdef', 'nterthionedshwaa')", "''", usual, usual, real, 0),
        (cut("hexes", 16, 64), given, join("'example '", usual), usual, sample, 0),
        (cut("b64", 16, 64), given, join("'sample '", usual), usual, sample, 0),
        (f"repeat({pick(18, ['-', 'x', '=', '0', 'ab', '_', 'a', '*'])}, 32 + {roll(19, 60)})", "''", usual, usual, real, 0),
        (join(pick(39, ["${", "{{", "$", "<"]), f"upper({word(40)})", "'_'", f"upper({pick(41, PLACEHOLDERS)})", pick(42, ["}", "}}", "", ">"])), given, usual, usual, real, 0),
        (join(pick(43, ["process.env.", "config.", "os.environ."]), word(44), title(45)), given, usual, usual, real, 0),
        (join(pick(46, ["get", "read", "make"]), title(47), title(48), "'()'"), given, usual, usual, real, 0),
        (f"translate({cut('hexes', 32, 60)}, 'abcdef', '012345')", "''", usual, usual, real, 0),
        (join(word(49), "'_'", word(50)), given, usual, usual, real, 0),
    ]
    names = ("value", "name", "before", "after", "path")
    cases = " ".join(f"WHEN {k} THEN struct({', '.join(f'cast({c} as string) as {n}' for c, n in zip(shape, names))}, {shape[5]}D as label)" for k, shape in enumerate(shapes))
    random = " || ".join(f"sha2(cast('finding {seed} {k} ' || id as binary), 512)" for k in range(2))
    rows = spark.range(n).selectExpr("id", f"{random} as hexes").withColumn("coded", F.regexp_replace(F.base64(F.unhex("hexes")), r"[=\r\n]", ""))
    rows = rows.selectExpr("id", "hexes", "regexp_replace(coded, '[+/]', '') as b64", "translate(coded, '+/', '-_') as url64", "translate(upper(substring(hexes, 1, 64)), '0189', 'GHJK') as caps")
    rows = rows.withColumn("plain", F.split(F.lit(" ".join(dictionary()[200:2200])), " "))
    # in a lambda, which is evaluated as it is and not compiled
    return rows.select("id", F.expr(f"transform(array(id), _ -> CASE cast(id % {len(shapes)} as int) {cases} END)")[0].alias("x")).select("id", "x.*")


def _tree_sql(node) -> str:
    """One tree of Spark ML, from its root node on, as nested CASE over the array ``f``: the share of the leaf's training rows that are secrets."""
    if node.getClass().getSimpleName() == "LeafNode":
        no, yes = node.impurityStats().stats()
        return f"{yes / (no + yes)!r}D"
    split = node.split()
    return f"CASE WHEN f[{split.featureIndex()}] <= {float(split.threshold())!r}D THEN {_tree_sql(node.leftChild())} ELSE {_tree_sql(node.rightChild())} END"


def forest_sql(model) -> str:
    """The probability of a secret, over the array ``f``: the mean of the trees' leaf shares."""
    trees = [_tree_sql(tree._java_obj.rootNode()) for tree in model.trees]
    return f"({' + '.join(trees)}) / {len(trees)}D"


_trained: dict[tuple, str] = {}


def vectors(labelled: DataFrame) -> DataFrame:
    """labelled with ``f``, the features."""
    # inside a lambda, where the long expression is evaluated as it is and not compiled
    each = F.transform(F.array(F.struct("value", "name", "before", "after", "path")), lambda x: features(*[x.getField(c) for c in ("value", "name", "before", "after", "path")], dictionary()))
    return labelled.withColumn("f", each[0])


def fit(labelled: DataFrame):
    """Spark ML's forest for labelled findings (value, name, before, after, path, label)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    rows = reliable(vectors(reliable(labelled)).select(array_to_vector("f").alias("features"), "label"))
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=64, seed=5, featureSubsetStrategy="onethird").fit(rows)


def train(spark: SparkSession, labelled: DataFrame | None = None) -> str:
    """The forest as SQL, trained on labelled findings; the default ones are used once per application."""
    key = (spark.sparkContext.applicationId, LABELLED, TREES, DEPTH)
    if labelled is None and key in _trained:
        return _trained[key]
    sql = forest_sql(fit(labelled if labelled is not None else labelled_findings(spark)))
    if labelled is None:
        _trained[key] = sql
    return sql


def _scored(rows: DataFrame, forest: str) -> DataFrame:
    """rows (row, text, path) with ``found``: array of (start, end, score) of the candidates' values."""
    rows = rows.withColumn("hits", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)))
    rows = rows.withColumn("at", located("text", "hits", F.lit(CANDIDATE), beside=True))
    name = lambda x: F.regexp_extract(x.getField("value"), f"^({ASSIGNED})?", 0)
    value = lambda x: F.substring(x.getField("value"), F.length(name(x)) + 1, F.length(x.getField("value")))
    own = lambda x: features(value(x), name(x), x.getField("before"), x.getField("after"), F.col("path"), dictionary())
    made = F.transform("at", lambda x: F.struct((x.getField("start") + F.length(name(x))).alias("start"), x.getField("end").alias("end"), own(x).alias("f")))
    rows = rows.withColumn("each", made)
    return rows.withColumn("found", F.expr(f"transform(each, x -> named_struct('start', x.start, 'end', x.end, 'score', transform(array(x.f), f -> {forest})[0]))")).drop("hits", "at", "each")


def _kept(docs: DataFrame, row: Column, labelled: DataFrame | None, path: str, above: float) -> DataFrame:
    """row, text, found, kept (those with a score above ``above``)."""
    rows = docs.select(row.alias("row"), F.coalesce("text", F.lit("")).alias("text"), F.col(path).alias("path"))
    return _scored(rows, train(docs.sparkSession, labelled)).withColumn("kept", F.filter("found", lambda x: x.getField("score") > above))


def _clean() -> Column:
    return replaced("text", "kept", lambda x: F.lit("[SECRET]"))


def scan(docs: DataFrame, labelled: DataFrame | None = None, path: str = "source", above: float = 0.5) -> DataFrame:
    """doc_id, n_candidates, ``secrets`` (start, end, score of those kept) and ``clean_text`` with each secret as [SECRET]."""
    rows = _kept(docs, F.col("doc_id").cast("long"), labelled, path, above)
    return rows.select(F.col("row").alias("doc_id"), F.size("found").cast("long").alias("n_candidates"), F.col("kept").alias("secrets"), _clean().alias("clean_text"))


def redact(docs: DataFrame, labelled: DataFrame | None = None, path: str = "source", above: float = 0.5) -> DataFrame:
    """The same columns with every secret of ``text`` as [SECRET]."""
    rows = _kept(docs, whole_row(docs), labelled, path, above).withColumn("clean", _clean())
    own = lambda c: F.when(F.col("row.text").isNotNull(), F.col("clean")) if c == "text" else F.col(f"row.{quoted(c)}")
    return rows.select(*[own(c).alias(c) for c in docs.columns])
