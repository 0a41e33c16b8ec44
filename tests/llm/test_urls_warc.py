import gzip
import hashlib
import random

import pytest

from folioscan.llm import exchange, url_filters, warc

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return rest[:cut].translate(UPPER), tail[:end]


def judged(url, rules, default):
    host, path = parts(url)
    fits = []
    for verdict, rule in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append((len(rule), rule, verdict))
    best = max(fits, key=lambda f: f[0], default=(0, None, default))
    return host, path, best[1], best[2]


URLS = [
    None, "", "no scheme/org/", "http://example.org/es/1", "https://www.EXAMPLE.org/en/1x?y#z", "ftp://example.org/en/2", "http://org/", "http://org", "http://notorg/", "http://a.b.com/fr/", "http://com/de/x", "http://com/fr/de/",
    "x://y://example.org/es/", "http://example.org?es/", "http://example.org#/es/", "http://.org/", "http://a..org/q", "http://example.org:80/es/", "http://xexample.org/es/", "://", "http://", "http:///es/", "http://ü.org/é", "http://a.example.org/es/" + "q" * 3000,
]


@pytest.mark.parametrize("slices", [1, 7])
@pytest.mark.parametrize("rules", [url_filters.RULES, (("block", "a.b.c.org/x/"), ("allow", "b.c.org/x/"), ("block", "c.org/x/y/"), ("allow", "org/x/y/z"), ("allow", "c.org/"), ("block", "c.org/"), ("allow", "d.org/x"))])
def test_rules_against_brute_force(spark, slices, rules):
    r = random.Random(3)
    made = [f"http://{'.'.join(r.choices('abcd', k=r.randrange(0, 4)) + ['c', 'org'][r.randrange(2):])}/{'/'.join(r.choices(['x', 'y', 'z', 'xy', ''], k=r.randrange(0, 4)))}" for _ in range(300)]
    urls = URLS + made + made[:5]
    pages = spark.createDataFrame([(i, u, "h", "k") for i, u in enumerate(urls)] + [(3, URLS[3], "h", "k"), (None, URLS[4], "h", "k")], "page_id long, url string, key string, slice string")
    got = url_filters.url_verdicts(pages, rules, "block", slices).collect()
    want = [(i, *judged(u, rules, "block")) for i, u in enumerate(urls)] + [(3, *judged(URLS[3], rules, "block")), (None, *judged(URLS[4], rules, "block"))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_many_rules_from_a_table(spark):
    """Rules are rows, and a slice is swept beside those of its own hosts only."""
    r = random.Random(5)
    rules = list(dict.fromkeys(f"h{r.randrange(4000)}.{r.choice(['org', 'com'])}/" + "/".join(r.choices("pq", k=r.randrange(0, 5))) for _ in range(30000)))
    given = [(n, ("allow", "block")[n % 2], rule) for n, rule in enumerate(rules)]
    table = spark.createDataFrame([*given, (len(given), "block", rules[0]), (None, None, "com/"), (1, "allow", None)], "n long, verdict string, rule string")
    urls = [f"http://www.h{r.randrange(4500)}.{r.choice(['org', 'com'])}/" + "/".join(r.choices("pqr", k=r.randrange(0, 6))) for _ in range(2000)]
    got = url_filters.url_verdicts(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), table, "none", 40)
    by_host = {}
    for _, verdict, rule in given:
        by_host.setdefault(rule.partition("/")[0], []).append((verdict, rule))
    want = [(i, *judged(u, by_host.get(parts(u)[0][4:], []), "none")) for i, u in enumerate(urls)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert len({v for *_, v in want}) == 3


def test_no_pages(spark):
    assert url_filters.url_verdicts(spark.createDataFrame([], "page_id long, url string")).count() == 0


HTML = [None, "", "short", "short", "é" * 49, "é" * 50, "é" * 50, "x" * 99, "x" * 99, "x" * 100, "x" * 100, "x" * 100, "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 6, "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 6, "\r\n\r\n\n\r", "long " * 60000]


def table(spark, rows=None):
    rows = [(i * 2, f"http://h/{i}", h, "x") for i, h in enumerate(HTML)] if rows is None else rows
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string")


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_round_trip(spark, tmp_path, compression):
    pages = table(spark)
    warc.write_archives(pages, str(tmp_path / "w"), compression=compression, file_bytes=100_000)
    read = warc.read_archives(spark, str(tmp_path / "w"))
    got = {r["page_id"]: r for r in read.where("kind = 'record'").collect()}
    assert read.where("kind = 'gap'").count() == 0 and len(got) == len(HTML)
    first = {}
    for i, h in enumerate(HTML):
        data = (h or "").encode()
        own = got[i * 2]
        assert (own["payload_bytes"], own["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
        again = len(data) >= 100 and data in first
        assert (own["record_type"], own["refers_to"]) == (("revisit", first[data]) if again else ("response", None))
        assert bytes(own["payload"]) == (b"" if again else data) and own["url"] == f"http://h/{i}"
        first.setdefault(data, i * 2)


def test_awkward_pages(spark, tmp_path):
    rows = [(None, None, "n" * 200, ""), (5, "u\r\nInjected: 1", "n" * 200, ""), (5, "u", "n" * 200, ""), (9, "v", "n" * 200, ""), (9, "v", "n" * 200, "")]
    got = warc.round_trip(table(spark, rows), str(tmp_path / "w")).collect()
    assert sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in got) == [("5", "response", None)] * 2 + [("9", "revisit", 5)] * 2 + [("None", "response", None)]
    assert warc.round_trip(table(spark, []), str(tmp_path / "e")).count() == 0


def test_urls_of_any_length(spark, tmp_path):
    long = "data:text/html;WARC/1.1," + "x" * (1 << 20)
    rows = [(1, "a", "m" * 200, ""), (2, long, "n" * 200, ""), (3, "b", "n" * 200, ""), (4, long, "n" * 200, ""), (5, long + "é", None, ""), (6, "c" * (1 << 16), "o", "")]
    pages = table(spark, rows)
    got = warc.round_trip(pages, str(tmp_path / "w")).collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in got) == [(1, "response", None), (2, "response", None), (3, "revisit", 2), (4, "revisit", 2), (5, "response", None), (6, "response", None)]
    read = warc.read_archives(spark, str(tmp_path / "w"))
    assert warc.gaps(read).count() == 0 and {r["page_id"]: r["url"] for r in read.collect()} == {r[0]: r[1] for r in rows}


def test_a_long_header_without_an_end_is_a_gap():
    records = archive()
    url = b"x" * 200_000
    whole = records[3].replace(b"http://h/3", url)
    cut = whole[: whole.index(url) + 150_000]
    for broken in (cut, cut + b"\r\n", cut.replace(b"\r\n", b"\n"), b"WARC/1.1 " * 20_000):
        found = list(warc.salvage(b"".join([*records[:3], broken, *records[4:]])))
        covered(found, sum(map(len, records)) - len(records[3]) + len(broken))
        assert [x["page_id"] for x in found if x["kind"] == "record"] == [0, 1, 2, 4, 5, 6, 7]
    assert [x["page_id"] for x in warc.salvage(b"".join([*records[:3], whole, *records[4:]]))] == list(range(8))


def archive(n=8):
    out = []
    for i in range(n):
        body = f"payload {i} ".encode() * (i + 1)
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Target-URI: http://h/{i}\r\nWARC-Payload-Digest: sha256:{hashlib.sha256(body).hexdigest()}\r\nContent-Length: {len(body)}\r\n\r\n".encode()
        out.append(head + body + b"\r\n\r\n")
    return out


def covered(found, size):
    at = 0
    for x in found:
        assert x["begin"] == at
        at = x["end"]
    assert at == size


def test_salvage_of_plain_bytes():
    records = archive()
    data = b"".join(records)
    r = random.Random(5)
    for _ in range(200):
        k = r.randrange(len(records))
        start = sum(map(len, records[:k]))
        broken = bytearray(data)
        how = r.randrange(4)
        if how == 0:  # a byte of the payload
            broken[start + len(records[k]) - 6] ^= 1
        elif how == 1:  # cut out a piece of the record
            del broken[start + 3 : start + len(records[k]) - r.randrange(1, 5)]
        elif how == 2:  # noise in its place
            broken[start : start + len(records[k])] = r.randbytes(50)
        else:  # a wrong length
            at = data.index(b"Content-Length: ", start) + 16
            broken[at : at + 1] = b"9"
        found = list(warc.salvage(bytes(broken)))
        covered(found, len(broken))
        good = [x["page_id"] for x in found if x["kind"] == "record"]
        assert good == [i for i in range(len(records)) if i != k], how
        assert any(x["kind"] == "gap" and x["reason"] for x in found)


def test_a_damaged_payload_is_not_read_as_records():
    records = archive()
    inner = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    posing = inner.replace(b"Content", b"WARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent")
    signed = archive(1)[0].replace(b"urn:page:0", b"urn:page:78")
    for k, body in ((0, inner * 3), (3, inner * 3), (3, posing), (0, posing), (3, signed)):
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{k}>\r\nWARC-Payload-Digest: sha256:{'0' * 64}\r\nContent-Length: ".encode()
        whole = head + str(len(body)).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
        false_length = head + str(len(body) + 7).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
        for broken in (whole, false_length)[: 1 + (body is not signed)]:
            data = b"".join([*records[:k], broken, *records[k + 1 :]])
            found = list(warc.salvage(data))
            covered(found, len(data))
            assert [x["page_id"] for x in found if x["kind"] == "record"] == [i for i in range(8) if i != k]
            assert [x["end"] - x["begin"] for x in found if x["kind"] == "gap"] == [len(broken)]


def test_salvage_of_gzip_members():
    records = archive()
    members = [gzip.compress(x, mtime=0) for x in records]
    data = b"".join(members)
    assert [x["page_id"] for x in warc.salvage_file(data)] == list(range(8))
    r = random.Random(6)
    for _ in range(100):
        k = r.randrange(8)
        start = sum(map(len, members[:k]))
        broken = bytearray(data)
        if r.random() < 0.5:
            broken[start + 1] ^= 0xFF  # its magic number
        else:
            del broken[start + len(members[k]) // 2 : start + len(members[k])]
        found = list(warc.salvage_file(bytes(broken)))
        good = [x["page_id"] for x in found if x["kind"] == "record"]
        assert set(range(8)) - {k} <= set(good)
        assert any(x["kind"] == "gap" for x in found)
    whole = gzip.compress(b"".join(records))
    assert [x["page_id"] for x in warc.salvage_file(whole)] == list(range(8))
    cut = [x for x in warc.salvage_file(whole[:-30])]
    assert [x["page_id"] for x in cut if x["kind"] == "record"] and cut[-1]["kind"] == "gap"
    assert list(warc.salvage_file(b"")) == []
    assert [x["kind"] for x in warc.salvage_file(b"nothing of the kind")] == ["gap"]


def test_gaps_are_logged(spark, tmp_path):
    data = b"".join(archive())
    (tmp_path / "a.warc").write_bytes(b"junk" + data[:300] + data[310:])
    read = warc.read_archives(spark, str(tmp_path))
    log = warc.gaps(read).collect()
    assert log[0]["begin"] == 0 and log[0]["end"] == 4 and all(g["file"].endswith("a.warc") and g["reason"] for g in log)


def test_blobs_come_back():
    import numpy as np

    x = [np.sort(np.random.default_rng(1).integers(0, 2**63, 50).astype(np.uint64)), np.arange(50, dtype=np.int32), np.zeros(0, np.uint8), np.array([-1], np.int8)]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(x, exchange.unpack(exchange.pack(x))))
    empty = exchange.unpack(exchange.pack([np.zeros(0, np.uint64)]))
    assert len(empty[0]) == 0
