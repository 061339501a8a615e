"""The order of the schedule reaches the results."""

from collections import Counter

from tabletools.llm.mixing import mixed_documents, taken_words
from tabletools.llm.queries import op9_mixing

SF = "/root/testdata/sf0.01"


def shares_of_runs(sources, words, run):
    """Per run of that many words: the share of each source."""
    out, now = [], Counter()
    for s, n in zip(sources, words):
        now[s] += n
        if sum(now.values()) >= run:
            out.append({k: v / sum(now.values()) for k, v in now.items()})
            now = Counter()
    return out


def test_rows_come_in_the_order_of_the_schedule(spark):
    docs = spark.createDataFrame([(i, f"s{i // 500}", "w " * (20 + i % 7), 0) for i in range(2000)],
                                 "doc_id long, source string, text string, n_chars int")
    rows = mixed_documents(docs).collect()
    words = [len(r.text.split()) for r in rows]
    whole = shares_of_runs([r.source for r in rows], words, sum(words) - 1)[0]
    runs = shares_of_runs([r.source for r in rows[:len(rows) * 4 // 5]], words, 16 * 256)
    assert len(runs) >= 10
    for run in runs[:len(runs) // 2]:
        assert all(abs(run.get(s, 0) - share) < 0.1 for s, share in whole.items()), (run, whole)
    assert [r.doc_id for r in mixed_documents(docs.repartition(7)).collect()] == [r.doc_id for r in rows]


def test_positions(spark):
    rows = taken_words(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert all((r.position is None) == (r.taken == 0) for r in rows)
    taken = [r.position for r in rows if r.taken]
    assert taken == sorted(taken) and [r.taken > 0 for r in rows] == [True] * len(taken) + [False] * (len(rows) - len(taken))
    assert [r.doc_id for r in op9_mixing(spark, SF).collect()][:len(taken)] == [r.doc_id for r in rows][:len(taken)]
