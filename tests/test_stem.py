import pytest

from hearthgraph.functions.stem import stem
from hearthgraph.operators import retrieval as R


@pytest.mark.parametrize(
    "word,want",
    [
        ("running", "run"), ("flies", "fli"), ("dies", "die"), ("generously", "generous"), ("happiness", "happi"), ("relational", "relat"),
        ("consistency", "consist"), ("knightly", "knight"), ("hopping", "hop"), ("hoping", "hope"), ("agreed", "agre"), ("caresses", "caress"),
        ("gas", "gas"), ("gaps", "gap"), ("skies", "sky"), ("communication", "communic"), ("national", "nation"), ("adjustment", "adjust"),
        ("controlled", "control"), ("rate", "rate"), ("cry", "cri"), ("say", "say"), ("by", "by"), ("conditional", "condit"), ("electricity", "electr"),
    ],
)
def test_stem(word, want):
    assert stem(word) == want


def test_stems_match(spark):
    chunks = spark.createDataFrame([("c1", "page", 1, 0, "She was hopping and hops", 1)], "chunk_id string, parent_type string, parent_id int, ord int, text string, tier int")
    q = spark.createDataFrame([(1, "hopped")], "query_id int, query string")
    assert R.lexical_arm(q, chunks).count() == 0
    assert R.lexical_arm(q, chunks, stem=True).first()["positions"] == 2
