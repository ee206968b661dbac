import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, fp long, key string, size int, _text string, n int, found string, copies int"


def prose(rng, n, lang="en"):
    parts = {"en": "the ing er th an on re he at ti ou".split(), "de": "sch ung ver der ein ich keit ge be lich".split(), "fr": "eau eux tion que ment ou è le ai re".split()}[lang]
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n)]
    return " ".join(words)


def corpus():
    """Rows of (doc_id, text, lang, source): prose in three languages, copies, near copies, shared passages, junk and odd cases."""
    rng = random.Random(3)
    rows, n = [], 0

    def add(text, lang="en", source=None):
        nonlocal n
        rows.append((n, text, lang, source if source is not None else f"src{n % 5}"))
        n += 1

    for lang in ("en", "de", "fr"):
        for _ in range(25):
            add(prose(rng, rng.randint(5, 150), lang), lang)
    passage = prose(rng, 60)
    for _ in range(4):
        add(prose(rng, 30) + " " + passage + "\n" + prose(rng, 30))
    long = prose(rng, 220)
    for k in range(6):  # copies, and copies with one word changed
        words = long.split(" ")
        if k > 2:
            words[10 * k] = "changed"
        add(" ".join(words), source="hot")
    add(" ".join(["round and round it goes"] * 40))
    add("token = \"" + "0123456789abcdef" * 2 + "01234567\" in it, mail me at a.b+c@ex-ample.co.uk or +1 (499) 555-6503 from 10.0.255.1 with 4111 1111 1111 1111 ok")
    add("fixed in commit " + "0123456789abcdef" * 2 + "01234567 and password=changeme123 for 999.1.1.1 or 1.2.3.4.5.6.7.8 a@b a@b.c.d@e.f")
    add("Released under the MlT Licence.\nAll  rights\treserved, CC-BY. The GNU General Public License cc by")
    add("%%% $$$ &&& words#### ***\nsame line\nsame line\n\n")
    add("ÀÉ çà ﬁ 𝒳𝒴 naïve " + prose(rng, 60))
    add("MIXED Case\x0bvertical\x0cform\x1cfile " + prose(rng, 40))
    add("▁ marker  two blanks ")
    add(prose(rng, 20_000))
    add("x" * 30_000)
    add("7" * 5_000 + " " + "1.2.3.4 " * 300 + "+" + "1" * 4000)
    for odd in (None, "", " \n\t ", "...", "1234", "a"):
        add(odd)
    add("no source", source="")
    rows.append((n, "null lang and source " + prose(rng, 12), None, None))
    rows.append((None, "null id " + prose(rng, 45), "en", "src1"))
    rows += [rows[3], rows[3], rows[80]]
    rows.append((rows[5][0], "another text of the same id " + prose(rng, 50), "en", "src0"))
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    full = [(i, t, lang, s, len(t or ""), 5, "k", 1, "t", 2, "f", 9) for i, t, lang, s in rows]
    return spark.createDataFrame(full, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def sorted_rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
