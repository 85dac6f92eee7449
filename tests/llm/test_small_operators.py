"""Operators 1, 2, 3, 6, 8 and 9 against plain versions, with nulls, empties, repeats and extra columns."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from parlance.llm import common, line_dedup, mixing, secrets, simhash, substring_dedup, warc

SPACE = "\x20\t\n\x0b\x0c\r"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# ---------------------------------------------------------------- 1


def pieces(t):
    found = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
    out, cur = [], []
    for i, (_, b) in enumerate(found):
        cur.append(i)
        if i + 1 == len(found) or t[b - 1] in ".!?" or "\n" in t[b : found[i + 1][0]] or len(cur) == substring_dedup.CUT:
            out.append(cur)
            cur = []
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    ends = [found[out[k + 1][0]][0] if k + 1 < len(out) else len(t) for k in range(len(out))]
    return [(found[c[0]][0], e, tuple(t[x:y].translate(lower) for x, y in (found[i] for i in c))) for c, e in zip(out, ends)]


def brute_substrings(rows):
    cut = {i: pieces(t or "") for i, t in rows}
    first, out = {}, {}
    runs = lambda s: [(p, tuple(x[2] for x in s[p : p + 3])) for p in range(len(s) - 2)]
    for i, _ in sorted(rows):
        for p, r in runs(cut[i]):
            first.setdefault(r, (i, p))
    for i, t in rows:
        gone = {q for p, r in runs(cut[i]) if r in first and first[r] != (i, p) for q in range(p, p + 3)}
        s = cut[i]
        out[i] = None if t is None else (t[: s[0][0]] if s else t) + "".join(t[a:b] for q, (a, b, _) in enumerate(s) if q not in gone)
    return out


def test_substrings_equal_brute_force(documents, prose):
    passage = prose(99, 60)
    rows = [(i, prose(i) + " " + passage + " " + prose(100 + i, 30)) for i in range(6)]
    rows += [(7, passage), (8, None), (9, ""), (10, "One. Two."), (11, "Äh über ß. " * 9), (12, prose(3, 4000)), (13, "x\n\n" + prose(5))]
    got = {r.doc_id: r.text for r in substring_dedup.substring_dedup(documents(rows)).collect()}
    assert got == brute_substrings(rows)
    assert passage in got[0] and passage not in got[1] and prose(101, 30) in got[1] and got[8] is None


def test_substrings_of_repeated_rows_and_columns(documents, prose):
    rows = [(1, prose(1)), (1, prose(1)), (2, prose(1)), (None, prose(2))]
    out = substring_dedup.substring_dedup(documents(rows))
    assert out.columns[:7] == ["doc_id", "text", "lang", "source", "n_chars", "id", "component"]
    got = sorted((r.doc_id or -1, r.text) for r in out.collect())
    assert got == [(-1, prose(2)), (1, prose(1)), (1, prose(1)), (2, "")]
    assert substring_dedup.substring_dedup(documents([])).count() == 0


def test_repeats_of_short_sentences_go(documents):
    long = " ".join(f"Um{i}! So{i}." for i in range(60))
    rows = [(1, long), (2, long), (3, "Mine. " + long + " Also mine."), (4, "Yes.\nNo.\nWell."), (5, "Yes.\nNo.\nWell."), (6, "Yes.\nNo.")]
    got = {r.doc_id: r.text for r in substring_dedup.substring_dedup(documents(rows)).collect()}
    assert got == {1: long, 2: "", 3: "Mine. Also mine.", 4: rows[3][1], 5: "", 6: rows[5][1]}
    assert got == brute_substrings(rows)


def test_repeats_out_of_phase_go(documents, prose):
    flat = lambda seed, n: prose(seed, n).replace(".", "").lower()
    rows = []
    for k in range(12):
        passage = flat(100 + k, 120)
        rows += [(k, flat(200 + k, 30) + " " + passage + " " + flat(300 + k, 25)), (100 + k, flat(400 + k, 31 + k % 9) + " " + passage)]
    whole = flat(999, 400).split()
    rows += [(500, " ".join(whole)), (501, " ".join(whole[:100] + ["more"] + whole[100:200] + whole[201:])), (502, "mine " + "la di da du " * 100)]
    rows += [(503, "la di da du " * 100)]
    got = {r.doc_id: r.text for r in substring_dedup.substring_dedup(documents(rows)).collect()}
    for k in range(12):
        assert got[k] == rows[2 * k][1]
        left = got[100 + k].split()
        assert rows[2 * k + 1][1].split()[: 31 + k % 9] == left[: 31 + k % 9]
        assert len(left) - (31 + k % 9) <= 30
    assert got[500] == rows[24][1] and len(got[501].split()) <= 90 and len(got[503].split()) <= 12


ODD = ["__marks", "__mark_id", "__removed", "__sentences", "__lines", "__others", "__deal", "a.b", "id", "h", "marks", "lines", "drop"]


@pytest.mark.parametrize("operator", [substring_dedup.substring_dedup, line_dedup.line_dedup])
def test_clashing_and_dotted_columns_stay(spark, prose, monkeypatch, operator):
    monkeypatch.setattr("parlance.llm.common.LEAST_HOT", 2)
    text = prose(1).replace(". ", ".\n")
    df = spark.createDataFrame([(i, text if i < 8 else None, *range(len(ODD))) for i in range(10)], ["doc.id", "the.text", *ODD])
    out = operator(df, id_col="doc.id", text_col="the.text")
    assert out.columns[:-2] == df.columns and len(set(map(str.lower, out.columns))) == len(out.columns)
    got = sorted(map(tuple, out.collect()))
    assert [r[1] for r in got] == [text] + [""] * 7 + [None, None]
    assert all(r[2:-2] == tuple(range(len(ODD))) for r in got) and [r[-1] > 0 for r in got] == [False] + [True] * 7 + [False] * 2


# ---------------------------------------------------------------- 2


def test_mix_reaches_targets_and_repeats_itself(documents, prose):
    rows = [(i, prose(i, 5 + i % 40)) for i in range(400)] + [(500, None), (501, "")]
    a = mixing.mix_sources(documents(rows)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, mixing.mix_sources(documents(rows)).collect()))
    size = {i: len(words(t)) for i, t in rows}
    by = {}
    for r in a:
        assert r["size"] == size[r.doc_id] and r.taken <= 2 * r["size"]
        by.setdefault(r.target, []).append(r)
    total = sum(size.values())
    assert sum(by) == pytest.approx(1.5 * total) and len(by) == 3
    for target, rs in by.items():
        assert abs(sum(r.taken for r in rs) - target) <= 90 and target <= 2 * rs[0].source_size + 1e-9


def test_mix_targets_by_water_filling(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 1000), (None, 10)], "source string, source_size long")
    t = {r.source: r.target for r in mixing.source_targets(sizes, (3, 1, 2), 1.5, 2.0).collect()}
    # a and the null source (weight 3) stop at twice their size; the rest goes 1 : 2
    assert t["a"] == 200 and t[None] == 20 and t["b"] == pytest.approx((3165 - 220) / 3) and t["c"] == pytest.approx((3165 - 220) * 2 / 3)


def test_the_plan_of_the_mix_is_short(documents, prose, plan):
    """The driver holds each plan with its compiled code, so the steps of the mix are written one by one."""
    text = plan(mixing.mix_sources(documents([(i, prose(i, n=3 + i % 5)) for i in range(12)])))
    assert text.count("Exchange ") + text.count("BroadcastExchange") <= 3 and "NestedLoop" not in text


def test_mix_of_nothing(documents):
    assert mixing.mix_sources(documents([])).count() == 0
    assert [r.taken for r in mixing.mix_sources(documents([(1, None), (1, None)])).collect()] == [0, 0]


# ---------------------------------------------------------------- 3


def brute_lines(rows, n=3):
    full = {i: [(k, x.strip(" \t\r\x0b\x0c")) for k, x in enumerate((t or "").split("\n")) if x.strip()] for i, t in rows}
    first, out = {}, {}
    for i, _ in sorted(rows):
        for p in range(len(full[i]) - n + 1):
            first.setdefault(tuple(x[1] for x in full[i][p : p + n]), (i, p))
    for i, t in rows:
        f = full[i]
        gone = {x[0] for p in range(len(f) - n + 1) if first[tuple(y[1] for y in f[p : p + n])] != (i, p) for x in f[p : p + n]}
        out[i] = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
    return out


def test_lines_equal_brute_force(documents, prose):
    block = "one line\n  two lines \nthree lines\nfour"
    rows = [(1, block + "\nmine"), (2, "a\n\none line\ntwo lines\nthree lines\n\nb"), (3, "x\nx\nx\nx\nx"), (4, None), (5, ""), (6, "\n\n"), (7, "two\nlines")]
    rows += [(8, "\n".join(prose(i, 5) for i in range(3000))), (9, prose(1, 5) + "\n" + prose(2, 5) + "\n" + prose(3, 5)), (10, block)]
    out = line_dedup.line_dedup(documents(rows))
    assert {r.doc_id: r.text for r in out.collect()} == brute_lines(rows)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "id", "component", "__lines", "__removed"]


def test_lines_of_repeated_rows(documents):
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc"), (None, "d\ne\nf")]
    got = sorted((r.doc_id or -1, r.text) for r in line_dedup.line_dedup(documents(rows)).collect())
    assert got == [(-1, "d\ne\nf"), (1, "a\nb\nc"), (1, "a\nb\nc"), (2, "")]
    assert line_dedup.line_dedup(documents([])).count() == 0


def test_lines_stay_in_the_jvm(documents, plan):
    assert "Python" not in plan(line_dedup.line_dedup(documents([(1, "a\nb\nc")]))) and "Arrow" not in plan(line_dedup.line_dedup(documents([(1, "a")])))


# ---------------------------------------------------------------- 6


def pages(spark, rows):
    return spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, key int")


def test_warc_round_trip(spark, tmp_path):
    long = "ü" * 80 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"
    rows = [(3, "http://a.b/c?d#e", long), (1, "http://a.b", long), (2, None, None), (4, "x\r\ny", "short"), (5, "http://h", "short"), (6, "http://i/é", ""), (7, "http://j", "z" * 300_000), (1, "http://a.b", long)]
    got = sorted(map(tuple, warc.round_trip(pages(spark, rows), f"file://{tmp_path}/w", file_bytes=200).collect()), key=repr)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = [(i, len((t or "").encode()), sha(t), "revisit" if i == 3 else "response", 1 if i == 3 else None) for i, _, t in rows]
    assert got == sorted(want, key=repr)


def test_warc_captures_are_nested(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_archives(pages(spark, [(1, "http://a.b/c", "<p>é</p>")]), path)
    c = warc.assemble(warc.read_archives(spark, path)).collect()
    assert len(c) == 1 and bytes(c[0].response.payload).decode() == "<p>é</p>"
    assert c[0].requests[0].head.startswith("GET /c HTTP/1.1\r\nHost: a.b") and "page_id: 1" in c[0].metadata[0].fields
    assert c[0].response.payload_digest == "sha256:" + c[0].response.payload_sha256


def test_warc_of_nothing(spark, tmp_path):
    assert warc.round_trip(pages(spark, []), f"file://{tmp_path}/w").count() == 0


def test_an_archive_of_uncompressed_records(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\n\r\nhi"
    rec = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    lone = b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <m>\r\nWARC-Concurrent-To: <zz>\r\nContent-Length: 3\r\n\r\na:b\r\n\r\n"
    (tmp_path / "x.warc").write_bytes(rec + lone)
    c = {r.capture_id: r for r in warc.assemble(warc.read_archives(spark, f"file://{tmp_path}")).collect()}
    assert c["<a>"].response.payload_bytes == 2 and c["<a>"].requests == [] and c["<zz>"].response is None


def record(kind, name, block, *fields):
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", *fields, f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_many_small_members_are_read_in_linear_time(spark, tmp_path):
    import gzip
    import time

    took = []
    for n in (2_500, 10_000):
        data = b"".join(gzip.compress(record("response", i, b"HTTP/1.1 200 OK\r\n\r\n" + hashlib.sha256(str(i).encode()).hexdigest().encode() * 20)) for i in range(n))
        began = time.perf_counter()
        assert sum(1 for _ in warc._records(data)) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 1
    (tmp_path / "x.warc.gz").write_bytes(data)
    got = warc.read_archives(spark, f"file://{tmp_path}")
    assert got.selectExpr("count(distinct record_id)", "sum(length(payload))", "count(damage)").first()[:] == (10_000, 10_000 * 1280, 0)


def test_damaged_archives(spark, tmp_path):
    import gzip

    sound, other = record("response", "a", b"HTTP/1.1 200 OK\r\n\r\nhi"), record("metadata", "m", b"a:b", "WARC-Concurrent-To:", "\t<a>")
    broken = record("response", "b", b"x").replace(b"Length: 1", b"Length: one")
    (tmp_path / "1.warc").write_bytes(sound + broken + other + record("metadata", "m2", b"c:d", "WARC-Concurrent-To: <a>"))
    (tmp_path / "2.warc.gz").write_bytes(b"".join(map(gzip.compress, (record("request", "q", b"GET / HTTP/1.1\r\n\r\n", "WARC-Concurrent-To: <a>"), broken, record("warcinfo", "i", b"x: y")))) + b"no member")
    (tmp_path / "3.warc").write_bytes(record("resource", "r", b"0123456789")[:-9])
    (tmp_path / "4.warc.gz").write_bytes(gzip.compress(record("resource", "s", bytes(range(256)) * 50))[:-40])
    (tmp_path / "5.warc").write_bytes(b"nothing of the kind")
    got = warc.read_archives(spark, f"file://{tmp_path}").collect()
    assert sorted((r.record_id or "", r.damage or "") for r in got) == sorted(
        [("<a>", ""), ("", "head"), ("<m>", ""), ("<m2>", ""), ("<q>", ""), ("", "head"), ("<i>", ""), ("", "bytes"), ("<r>", "cut"), ("<s>", "cut"), ("", "cut")]
    )
    c = {r.capture_id: r for r in warc.assemble(warc.read_archives(spark, f"file://{tmp_path}")).collect()}
    assert [(m.record_id, m.fields) for m in c["<a>"].metadata] == [("<m2>", "c:d"), ("<m>", "a:b")] and [q.record_id for q in c["<a>"].requests] == ["<q>"]


def test_archives_are_bounded_and_have_a_member_for_each_record(spark, tmp_path, monkeypatch):
    import zlib

    monkeypatch.setattr("parlance.llm.common.LEAST_HOT", 2)
    rows = [(i, f"http://a/{i}", hashlib.sha256(str(i).encode()).hexdigest() * 40 if i % 3 else "same " * 40) for i in range(60)]
    got = warc.round_trip(pages(spark, rows).repartition(2), f"file://{tmp_path}/w", file_bytes=2_000).collect()
    first = {}
    for i, _, t in rows:
        first.setdefault(t, i)
    want = [(i, len(t), hashlib.sha256(t.encode()).hexdigest(), "revisit" if first[t] < i else "response", first[t] if first[t] < i else None) for i, _, t in rows]
    assert sorted(map(tuple, got)) == want
    files = [f for f in (tmp_path / "w").iterdir() if f.name.startswith("part")]
    assert len(files) > 8 and all(f.stat().st_size < 5_000 for f in files)
    rest, members = files[0].read_bytes(), []
    while rest:
        z = zlib.decompressobj(31)
        members.append(z.decompress(rest) + z.flush())
        assert z.eof
        rest = z.unused_data
    assert all(m.startswith(b"WARC/1.1") and m.count(b"WARC-Type:") == 1 for m in members[:-1]) and members[-1] == b""


# ---------------------------------------------------------------- 8


def test_simhash_edited_texts_and_likeness(documents, prose):
    rows = [(i, prose(i, 120)) for i in range(1, 9)] + [(9, None), (10, "ünï cödé"), (11, prose(1, 120)), (100, "w"), (200, prose(1, 120))]
    got = {r.doc_id: r for r in simhash.fingerprint_documents(documents(rows)).collect()}
    texts = [t or "" for _, t in rows]
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", texts[(k + 1) % len(rows)]
        q = len(t) // 4
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest()
    assert got[1].fingerprint == got[11].fingerprint == got[200].fingerprint and got[9].fingerprint == "0" * 16
    assert sum(got[i].near_edited for i in range(1, 9)) > sum(got[i].near_next for i in range(1, 9)) + 1
    assert got[200].n_within == 3 and got[100].n_within == 1 and got[1].n_within is None


def brute_print(t):
    low = t.lower()
    w = words(low)
    gaps = [m.group(1) for m in re.finditer(r"(?<![^\x20\x09-\x0D])(?=([^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]+))", low)]
    return gaps if len(w) > 1 else w


def test_fingerprints_are_majority_votes(spark, documents, prose):
    from pyspark.sql import functions as F

    texts = [prose(3, 50), "one", "", prose(4, 9000)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {r.k: r.fingerprint for r in simhash.simhash(df, ["k"], ["text"]).collect()}
    for k, t in enumerate(texts):
        terms = brute_print(t)
        votes = [0] * 64
        if terms:
            h = spark.createDataFrame([(x,) for x in terms], "t string").select(F.xxhash64("t"), simhash.weight(F.col("t"))).collect()
            for code, weight in h:
                for b in range(64):
                    votes[b] += weight if (code >> b) & 1 else -weight
        assert int(got[k], 16) == sum(1 << b for b in range(64) if votes[b] > 0)


def test_block_tables_find_all_within_the_radius(spark):
    import random

    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = {f"{x:016x}" for b in base for x in [b] + [b ^ sum(1 << p for p in rng.sample(range(64), rng.randrange(1, 6))) for _ in range(6)]}
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint string")
    got = sorted((r.query, r.found, r.distance) for r in simhash.within_radius(df, df).collect())
    want = sorted((a, b, d) for a in prints for b in prints if (d := bin(int(a, 16) ^ int(b, 16)).count("1")) <= 3)
    assert got == want


def test_simhash_of_odd_tables(documents, plan):
    assert simhash.fingerprint_documents(documents([])).count() == 0
    got = simhash.fingerprint_documents(documents([(None, "a b"), (1, "c d"), (1, "c d"), (1, "e f")])).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "None"]
    assert "Python" not in plan(simhash.fingerprint_documents(documents([(1, "a b")])))


# ---------------------------------------------------------------- 9


def brute_secrets(t):
    out = []
    for m in re.finditer(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        if len(m.group(1)) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 24]
    return sorted(out)


CASES = [
    "",
    "Password: hunter2x, ünï token='abc' SECRET = \"q.w/e+r-t\" api_key=aaaaaa apikey :bbbbbb",
    "secret=token: abcdefgh",
    "AKIA" + "A" * 16 + " AKIA" + "B" * 15 + " AKIAAKIA" + "C" * 12 + "x" + "0" * 23 + " " + "f" * 24 + "g" + "e" * 30,
    "token = 0123456789abcdef0123456789abcdef 😀 passwd:xxxxxx",
    "no secrets here",
]


def bare(spans):
    return [(s.start, s.rank, s.kind, s.end) for s in spans if s.rank < 3]


def test_secrets_equal_brute_force(documents, monkeypatch):
    monkeypatch.setattr("parlance.llm.common.LEAST_HOT", 2)
    rows = list(enumerate(CASES)) + [(10, CASES[1]), (11, None), (None, CASES[4])] + [(100 + i, CASES[3]) for i in range(12)]
    got, _, ledger = secrets.scan_versions(documents(rows))
    found = got.collect()
    assert len(found) == len(rows)
    by = {r.id: bare(r.spans) for r in found}
    for i, t in rows:
        assert by[i] == brute_secrets(t or "")
    assert ledger.count() == len(CASES) and all(len(r.pairs) == len(secrets.RULES) for r in ledger.collect())


def test_only_unseen_pairs_are_scanned(documents):
    first = documents([(1, CASES[1]), (2, CASES[4])])
    _, known, ledger = secrets.scan_versions(first)
    again = documents([(3, CASES[1]), (4, CASES[3])])
    got, _, more = secrets.scan_versions(again, ledger=ledger, known=known)
    assert more.select("blob").distinct().count() == 1
    by = {r.id: bare(r.spans) for r in got.collect()}
    assert by == {3: brute_secrets(CASES[1]), 4: brute_secrets(CASES[3])}
    newer = tuple(r._replace(version="2") if r.kind == "hex" else r for r in secrets.RULES)
    _, _, third = secrets.scan_versions(first, rules=newer, ledger=ledger)
    assert {p for r in third.collect() for p in r.pairs} == {"hex@2"}


def test_findings_of_a_changed_rule_go(documents):
    docs = documents([(1, "0" * 24 + " x " + "1" * 30 + " AKIA" + "A" * 16)])
    _, known, ledger = secrets.scan_versions(docs)
    newer = tuple(r._replace(version="2", least=28, pattern="[0-9a-f]{28,}") if r.kind == "hex" else r for r in secrets.RULES)
    (row,) = secrets.scan_versions(docs, newer, ledger, known)[0].collect()
    assert [(s.start, s.kind, s.version, s.end) for s in row.spans] == [(27, "hex", "2", 57), (58, "access", "1", 78)]
    fewer = tuple(r for r in secrets.RULES if r.kind != "hex")
    (row,) = secrets.scan_versions(docs, fewer, ledger, known)[0].collect()
    assert [s.kind for s in row.spans] == ["access"]
    (row,) = secrets.scan_runs(docs, (secrets.BASE_RULES, newer)).collect()
    assert [(s.start, s.kind) for s in row.spans] == [(27, "hex"), (58, "access")]


def test_many_hits_in_one_long_text(documents):
    text = "".join(f"é token={i:06d} {'0123456789abcdef' * 2} " for i in range(50_000))
    (row,) = secrets.scan_versions(documents([(1, text)]))[0].collect()
    assert bare(row.spans) == brute_secrets(text) and len(row.spans) == 100_000


def test_secrets_stay_in_the_jvm(documents, plan):
    docs = documents([(1, CASES[1])])
    got, _, _ = secrets.scan_versions(docs)
    found, _ = secrets.scan_blobs(docs.select(secrets.blob_id("text").alias("blob"), "text"))
    assert "Python" not in plan(got) and "Arrow" not in plan(found) and "Python" not in plan(found)
    assert secrets.scan_versions(documents([]))[0].count() == 0


# ---------------------------------------------------------------- written tables


def test_what_is_seen_of_a_table_while_it_is_written(spark):
    df = spark.range(10).selectExpr("id % 3 AS k").groupBy("k").agg(F.count("*").alias("n"))
    out, seen = common.written(df, "seen", "n")
    assert (out.count(), tuple(seen)) == (3, (3, 10, 4))
    assert tuple(common.written(out, "seen")[1]) == (3, 3, 1)
    for nothing in (df.where("false"), df.where("n > 99"), spark.createDataFrame([], "k long, n long")):
        assert tuple(common.written(nothing, "seen", "n")[1]) == (0, 0, 0)


def test_components_take_no_queries_for_counts(spark):
    def ran():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return spark._jsparkSession.sharedState().statusStore().executionsCount()

    edges = spark.createDataFrame([(1, 2), (2, 3), (8, 9)], "a long, b long").coalesce(1)
    before = ran()
    got = common.connected_components(edges)
    # of each round near, step, placed and edges, and from the second on moves; then first and components
    assert ran() - before <= 13
    assert {(r.node, r.component) for r in got.collect()} == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)}
