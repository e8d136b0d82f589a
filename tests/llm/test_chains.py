"""Walks along chains of hosts."""

from rasterloom.llm import urlgraph
from rasterloom.llm.urlgraph import Rule


def test_walks_end_at_the_horizon_however_long_a_chain(spark):
    """A chain to a blocked host: those within the horizon are blocked, further ones get less than SETTLED of its distrust and are allowed."""
    n, damping = 60, 0.5
    most = urlgraph.horizon(damping)
    assert most == 24 and urlgraph.horizon(urlgraph.DAMPING) == 100
    rows = [(k, f"https://h{k}.net/x", f'<a href="https://h{k + 1}.net/y">' if k + 1 < n else "") for k in range(n)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in urlgraph.judge(pages, [Rule(f"h{n - 1}.net", "/", "block")], damping=damping).collect()}
    assert {k for k, v in got.items() if v == "block"} == set(range(n - 1 - most, n))
    scores = {r.host: r.distrust for r in urlgraph.host_scores(pages, [Rule(f"h{n - 1}.net", "/", "block")], damping=damping).collect()}
    assert all(s * 0.5 <= urlgraph.SETTLED for h, s in scores.items() if h == f"h{n - 1 - most}.net")
