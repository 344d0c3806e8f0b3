import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and thing onble heerth thesea inther that ereing tion ouer ster andre inly".split()
MOTS = "le de et que ouaux éeuxle elleon ènier avec étreoi leçan mentré pas sur éouanle".split()


def prose(n, seed, words=WORDS):
    x, out = seed * 2654435761 % 2**32, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(words[x // 65536 % len(words)])
    return " ".join(out)


def corpus():
    """Two hundred texts in two languages, with copies, near copies, junk, secrets, nulls and empty texts."""
    rows = []
    for k in range(200):
        lang = "fr" if k % 4 == 0 else "en"
        rows.append((k, prose(60 + k % 90, k, MOTS if lang == "fr" else WORDS) + f".\nLine {k % 7}.", lang, f"src{k % 3}", 1))
    rows += [(300 + k, rows[5][1], "en", "src0", 1) for k in range(20)]
    rows += [(400 + k, rows[6][1] + f" tail{k}", "en", "src0", 1) for k in range(5)]
    rows += [(500, None, None, None, None), (501, "", "en", "", 0), (502, " \n\t ", None, "x", 3), (503, "12 34 ### !!", "en", "x", 9), (None, rows[7][1] + " extra", None, "x", 1), (None, "alone without id", "en", None, 2)]
    rows += [(504, 'password="Zx9/abcd1234" AKIA' + "A1B2C3D4E5F6G7H8 " + "0123456789abcdef" * 3, "en", "x", 1), rows[9], rows[9]]
    rows.append((505, prose(30_000, 1) + "\n" + "x" * 50_000, "en", "x", 1))
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


@pytest.fixture(scope="session")
def odd_docs(docs):
    """The corpus with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = ("fp", "component_id", "ids", "curve", "language", "lang_pred", "kept", "key", "size", "label", "media", "_key", "_fp", "host")
    return docs.select("*", *[F.lit(f"own {n}").alias(n) for n in names])


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def texts():
    return corpus()
