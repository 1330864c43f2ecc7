"""Copies of a text go through the index of op10 once, whatever their number."""

from diurna.llm import substring_dedup


def test_copies_are_dealt_to_shards_once(spark, monkeypatch):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    dealt, real = [], substring_dedup.repeats_in_shards

    def shards(parts):
        dealt.append(parts.count())
        return real(parts)

    monkeypatch.setattr(substring_dedup, "repeats_in_shards", shards)
    monkeypatch.setattr(substring_dedup, "HOT", 1000)
    for copies in (2, 12):
        rows = [(k, a) for k in range(copies)] + [(100, b), (50, f"{a} {b}"), (101, b), (None, f"c {b}"), (70, "a0 a1")]
        docs = spark.createDataFrame(rows, "doc_id int, text string")
        found = {r.doc: r.n_removed for r in substring_dedup.remove_repeats(docs).collect()}
        assert found == {None: 0, 0: 0, **dict.fromkeys(range(1, copies), 60), 50: 120, 70: 0, 100: 60, 101: 60}
    assert dealt[0] == dealt[1]
