import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, size string, spans string, score string, node string"


def words(n, seed=0):
    """n different-looking words, the same for a seed."""
    return " ".join(f"w{(i * 7919 + seed * 104729) % 100003}x{seed}" for i in range(n))


def hard_rows():
    """Nulls, empty and blank texts, one very long text, near and exact copies, ties and repeated rows."""
    base = words(300, 1)
    near = base.replace("w7919x1", "changed")
    long = words(60_000, 2)
    texts = [None, "", " \t\n \x0b", "one", "two words", base, base, near, "Ünïcode ß " + words(80, 3), "\n".join([words(12, 4)] * 3), "a " * 400, long, "x " + base, "12 34 !! %%% ##", words(49, 1), words(50, 1), words(51, 1)]
    rows = [(i, t, ("en", "de", None)[i % 3], ("s1", "s2", None)[i % 3], len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[5])  # a repeated row
    rows.append((6, "another text under an id that is taken", "en", "s1", 0))
    rows.append((None, base, None, None, None))
    return [(*r, "s", "z", "p", "q", "n") for r in rows]


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
