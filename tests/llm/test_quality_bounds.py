"""A source of which much is junk does not lift its own thresholds."""

import numpy as np
import pytest

from aerolens.llm import quality

WORDS = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500)]


@pytest.mark.parametrize("percent", [30, 40, 60])
def test_junk_of_one_source_is_rejected(spark, percent):
    rng = np.random.default_rng(percent)
    good = lambda: " ".join(w + rng.choice(["", "", ",", "."]) for w in rng.choice(WORDS, 80))
    junk = lambda: " ".join(w + "#$%" * int(rng.integers(1, 9)) for w in rng.choice(WORDS, 80))
    rows = [(i, junk() if i % 100 < percent else good(), "en", "bad") for i in range(300)]
    rows += [(1000 + i, good(), "en", f"good{i % 2}") for i in range(600)]
    rows += [(2000 + i, " ".join(w + "#" for w in rng.choice(WORDS, 80)), "en", "code") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality.quality(docs).where("kept").collect()}
    assert kept == {i for i, *_ in rows if i >= 1000 or i % 100 >= percent}
