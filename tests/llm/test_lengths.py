"""Values of any length."""

from rasterloom.llm import pii


def test_secrets_of_any_length(spark):
    texts = [f"the token is {'a1B2' * n} here" for n in (5, 50, 51, 100, 5000)] + [f"slack xoxb-{'9aZ' * n}!" for n in (4, 70, 900)] + [f"pay sk_live_{'0aB' * n}." for n in (8, 34, 700)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.digest(pii.find(docs)).collect()}
    for k, t in enumerate(texts):
        value = t.split()[3] if k < 5 else t.split()[1][:-1]
        at = t.index(value)
        assert f":{at}:{at + len(value)}" in got[k], (k, got[k])
