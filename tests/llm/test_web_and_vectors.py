"""Archive, URL rules, vectors and components against plain Python."""

import base64
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.llm import covertree, urlrules, warc
from geoloom.llm.components import connected


def key(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_archive(spark, tmp_path):
    rows = [(1, "http://a.org/x", "page one", "z"), (2, None, None, "z"), (3, "http://b/", "", "z"), (4, "http://c/\r\nX: y", "page one", "z"), (5, "http://d/", "é" * 9000, "z"), (5, "http://d/", "é" * 9000, "z"), (None, "u", "page one", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    folder = f"{tmp_path}/archive"
    warc.write_archive(pages, folder)
    top = {}
    for r in rows:
        if r[0] is not None:
            top[r[2] or ""] = max(top.get(r[2] or "", 0), r[0])
    want = []
    for i, _, html, _ in rows:
        body = (html or "").encode()
        first = top[html or ""]
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if i == first else "revisit", None if i == first else first))
    got = warc.read_archive(spark, folder)
    assert key(got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == key(want)
    for r in got.collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        length = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
        assert rest[length:] == b"\r\n\r\n" and length == (r.payload_bytes if r.record_type == "response" else 0)
        assert b"\r\nX:" not in head
    assert spark.read.parquet(f"{folder}/payloads").count() == 3
    warc.export_warc(got, f"{tmp_path}/files")
    whole = b"".join(p.read_bytes() for p in sorted((tmp_path / "files").glob("part-*")))
    assert whole.count(b"WARC/1.1\r\n") == len(rows) and len(whole) == sum(len(r.record) for r in got.collect())
    warc.write_archive(pages.limit(0), f"{tmp_path}/none")
    assert warc.read_archive(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("old, new", [("Content-Length: 8", "Content-Length: 7"), ("sha1:", "sha1:A"), ("WARC-Type: response", "WARC-Type: revisit")])
def test_records_that_do_not_fit_their_header_fail(spark, tmp_path, old, new):
    pages = spark.createDataFrame([(1, "http://a/", "page one"), (2, "http://b/", "other text")], "page_id long, url string, html string")
    warc.write_archive(pages, f"{tmp_path}/good")
    spark.read.parquet(f"{tmp_path}/good/payloads").write.parquet(f"{tmp_path}/bad/payloads")
    records = spark.read.parquet(f"{tmp_path}/good/records")
    records.select("digest", F.replace(F.col("header").cast("string"), F.lit(old), F.lit(new)).cast("binary").alias("header")).write.parquet(f"{tmp_path}/bad/records")
    assert warc.read_archive(spark, f"{tmp_path}/good").select("payload_digest").count() == 2
    with pytest.raises(Exception, match="does not match its header"):
        warc.read_archive(spark, f"{tmp_path}/bad").collect()


def test_url_rules(spark):
    rules = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"), ("allow", "com/de/"), (None, "x/"), ("block", None)]
    urls = ["http://www.Example.ORG/en/12?x", "http://example.org/es/a", "https://a.com/de/", "https://a.com/DE/", "ftp://org", "nothing", None, "", "http://notexample.org/es/", "http://a.com/fr/#/de/", "http://xcom/de/", "http://ÉX.org/\nb", "http://b.com/de/://c.org/", "http://a.com/de/"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(None, urls[0], "clash")], "page_id long, url string, host string")
    table = spark.createDataFrame(rules, "action string, rule string")

    def judge(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
        fits = []
        for action, rule in rules:
            if action and rule:
                rh, rp = rule.split("/", 1)
                if (host == rh or host.endswith("." + rh)) and path.startswith("/" + rp):
                    fits.append((len(rule), len(rh), action == "block", rule, action))
        best = max(fits, default=None)
        return host, path, best and best[3], best[4] if best else "allow"

    got = urlrules.judge_urls(pages, table).collect()
    assert key(got) == key((i, *judge(u)) for i, u in [*enumerate(urls), (None, urls[0])])
    assert {r.verdict for r in urlrules.judge_urls(pages, table.limit(0)).collect()} == {"allow"}


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 6))
    x = base[rng.integers(0, 40, 300)] + rng.normal(size=(300, 6)) * rng.choice([0, 0.02, 0.08, 0.2], 300)[:, None]
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(x)]
    odd = [(900, None, 1), (901, [0.0] * 6, 1), (902, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0], 1), (903, rows[0][1], None), (None, rows[0][1], 0), (5, rows[5][1], 2), (904, [1.0], 1), (905, [], 1), (906, [None] * 6, 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    good = rows + [odd[5], odd[6]]
    links, ids = {}, [r[0] for r in good]
    label = list(ids)
    pairs = []
    for a, (_, u, g) in enumerate(good):
        for b, (_, v, h) in enumerate(good):
            if a != b and g == h and len(u) == len(v) and np.dot(u, v) / np.linalg.norm(u) / np.linalg.norm(v) >= 0.98:
                links[a] = links.get(a, 0) + 1
                pairs.append((a, b))
    for _ in range(100):
        for a, b in pairs:
            label[a] = min(label[a], label[b])
    want = [(i, links.get(k, 0), label[k], i == label[k]) for k, i in enumerate(ids)] + [(o[0], 0, o[0], True) for o in odd if o[0] not in (5, 904)]
    for cell_rows in (16, 4096):
        assert key(covertree.near_vectors(df, cell_rows=cell_rows).collect()) == key(want)


def test_tree_covers_its_points():
    x = np.random.default_rng(1).normal(size=(500, 3))
    t = covertree.cover_tree(x, leaf=8)
    assert sorted(np.concatenate(t.points).tolist()) == list(range(500))
    for k, rows in enumerate(t.points):
        if len(rows):
            assert np.linalg.norm(x[rows] - x[t.center[k]], axis=1).max() <= t.radius[k] + 1e-12


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 130)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = dict(connected(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(100, 130)} == {100} and got[201] == 200
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0
