"""Tables of pairs that outgrow half a million rows are still sent to the tasks: positions stay arrays."""

import numpy as np

from diurna.llm import phrases


def test_large_tables_of_pairs_do_not_turn_positions_into_rows(spark, monkeypatch):
    def rows(*_):
        raise AssertionError("positions became rows")

    monkeypatch.setattr(phrases, "_positions", rows)
    words = np.random.default_rng(4).integers(0, 1200, (20, 50_000))
    docs = spark.createDataFrame([(i, " ".join(f"w{w}" for w in x), "en") for i, x in enumerate(words.tolist())], "doc_id int, text string, lang string")
    found = phrases.collocations(docs, least=1, longest=3, covered=10**6, top=None)
    pairs, n = np.unique(words[:, :-1] * 1200 + words[:, 1:], return_counts=True)
    triples = np.unique((words[:, :-2] * 1200 + words[:, 1:-1]) * 1200 + words[:, 2:])
    assert len(pairs) > 1 << 19
    counts = {r.k: (r.rows, r.a) for r in found.selectExpr("size(split(phrase, ' ')) AS k", "a").groupBy("k").agg({"a": "sum", "*": "count"}).toDF("k", "a", "rows").collect()}
    assert counts == {2: (len(pairs), int(n.sum())), 3: (len(triples), 20 * 49_998)}
