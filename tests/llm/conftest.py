import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Rows with what may come: nulls, empty and one-word texts, copies, ties, odd white space, very long texts, extra columns."""
    from pyspark.sql import types as T

    base = "the quick brown fox jumps over the lazy dog and runs far away from all of the hounds that follow it through the wood"
    rows = [(i, " ".join(base.split()[i % 5 :] + [f"w{j * i % 17}" for j in range(i % 40)]), "en", f"src{i % 3}", 0) for i in range(60)]
    rows += [(100, None, None, None, None), (101, "", "en", "src0", 0), (102, "word", "en", "src1", 4), (103, "two words", "en", "src1", 9), (104, " \n\t ", "en", None, 4)]
    rows += [(105, base, "en", "src0", 1), (106, base, "en", "src0", 1), (107, base.upper(), "en", "src9", 1), (107, base, "en", "src9", 1), (108, base + "\n" + base + "\n" + base, "fr", "src2", 1)]
    rows += [(110, "é ñ 中文 😀  x\u0085y <|endoftext|> it's we'll   end  ", "fr", "src2", 1), (111, ("lorem ipsum dolor " * 3000) + base, "en", "src1", 1), (112, "x" * 3000, "en", "src1", 1)]
    rows += [rows[3], rows[3], rows[7], (105, base, "en", "src0", 1), (100, None, None, None, None)]  # exactly repeated
    rows += [(None, base + " more", "en", "src0", 1), (-7, "negative " + base, "en", "src0", 1)]
    kind = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
    return spark.createDataFrame(rows, kind).repartition(3)


@pytest.fixture(scope="session")
def clashing(documents):
    """The same with columns named as the operators' own."""
    from pyspark.sql import functions as F

    names = ["size", "taken", "target", "fingerprint", "fp", "key", "block", "copy", "n", "root", "kept", "n_words", "_copy", "_row", "_size", "_key", "_source", "_s", "grp", "grp_", "keep", "row_fp", "root", "part", "kind", "payload"]
    return documents.withColumns({n: F.lit("x") for n in names})
