import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n long, u long, v long, label string, size int, target string, `_gone` int, `__of` string, h long, key string, rep long, w long, seq int, held_out string, spans string"


@pytest.fixture(scope="session")
def docs(spark):
    """docs(texts, ...) -> DataFrame of documents with columns whose names clash with those that operators use."""

    def make(rows):
        full = []
        for r in rows:
            d, t, s = (*r, "s")[:3] if isinstance(r, tuple) else (len(full), r, "s")
            full.append((d, t, None, s, None if t is None else len(t)) + (1.0, 2, 3, 4, "x", 5, "t", 6, "of", 7, "k", 8, 9, 10, "yes", "z"))
        return spark.createDataFrame(full, SCHEMA)

    return make
