import pytest
from pyspark.sql import functions as F

LONG = "the quick brown fox jumps over the lazy dog and runs on " * 8000


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in any column, empty, very long, equal and repeated rows, columns with names that operators use inside."""
    rows = [
        (1, "The small house stands by the river, and the old tree stands near the house. It is quiet there in the evening.", "en", "a", 9, "x", 0.5),
        (1, "The small house stands by the river, and the old tree stands near the house. It is quiet there in the evening.", "en", "a", 9, "x", 0.5),
        (2, "The small house stands by the river, and the old tree stands near the house. It is quiet there in the evening.", None, None, None, None, None),
        (3, None, None, None, None, None, None),
        (4, "", "en", "", 0, "", 0.0),
        (None, "Das kleine Haus steht am Fluss, und der alte Baum steht nahe bei dem Haus. Es ist ruhig dort am Abend.", "de", "b", 1, "y", 1.0),
        (5, LONG, "en", "a", len(LONG), "z", 2.0),
        (6, "12 345 !!!", "de", "c", 3, "w", None),
        (7, "licensed under the MIT license, and under the GNU General Public License version 3; MIT License", "en", "c", 3, "w", None),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, sig string, score double")
    for k, name in enumerate("words present starts p0 postings bucket block row place host path verdict media k1 k2 _k1 _kept_id kept_id class size text_crc32 task open fill".split()):
        frame = frame.withColumn(name, F.lit(k) if k % 2 else F.lit("x"))
    return frame


@pytest.fixture(scope="session")
def empty(spark, edge):
    return spark.createDataFrame([], edge.schema)
