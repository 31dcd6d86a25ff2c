"""The ten operators against brute force on small fixtures, with nulls, repeats, ties and clashing columns."""

import hashlib
import random
import re
import struct
import time
import unicodedata
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import common, components, decontamination, embedding_dedup, ngram_join, packing, pii, queries, sharding, substring_dedup, token_counts, toxicity, warc
from tracewright.llm.common import Scratch

#: Columns that operators use for themselves or return.
CLASHING = ("id", "n", "sig", "key", "row_key", "size", "grp", "range", "score", "component_id", "n_tokens", "spans", "raw", "block", "words")
SCHEMA = "doc_id long, text string"


def clashing(df, names=CLASHING):
    return df.withColumns({c: F.lit(-1) for c in names})


def prose(rng, n):
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "ter", "un", "sol"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, rng.randint(20, 200)) for _ in range(30)]
    out = [*base, *base[:5]]
    for t in base[:12]:  # near copies
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    return [*out, None, "", "  \n ", "one two", "one two", "é ñ ß", prose(rng, 20_000), "x" * 50_000, "again " * 3000]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, "no id here"), (None, None), (7000, texts[0])]
    return clashing(spark.createDataFrame(rows, SCHEMA).repartition(5))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ordered(rows):
    return sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))


# op1


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_spans(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_equal_patterns():
    rng = random.Random(1)
    for _ in range(20_000):
        t = "".join(rng.choice("a.12 -+@(9)0\né") for _ in range(rng.randint(0, 40)))
        assert pii.find_base(t) == base_spans(t), t
    assert pii.find_base("4242 4242 4242 4242, +1 (555) 123-4567") == [("card", 0, 19), ("phone", 21, 38)]


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("mail jоhn@exаmple.com now", "email", "jоhn@exаmple.com"),
        ("to john [at] example [dot] com.", "email", "john [at] example [dot] com"),
        ("john dot doe at example dot com", "email", "john dot doe at example dot com"),
        ("call plus one four one five five five five two six seven one ok", "phone", "plus one four one five five five five two six seven one"),
        ("card four two four two 4242 4242 4242", "card", "four two four two 4242 4242 4242"),
        ("at １９２．１６８．０．１ now", "ip", "１９２．１６８．０．１"),
        ("ask john@example dot com", "email", "john@example dot com"),
        ("ask john [at] example dot com", "email", "john [at] example dot com"),
        ("ask john at example [dot] com", "email", "john at example [dot] com"),
        ("ask john at example dot ai.", "email", "john at example dot ai"),
        ("host 192 dot 168 dot 0 dot 1.", "ip", "192 dot 168 dot 0 dot 1"),
        ("host 192·168·0·1", "ip", "192·168·0·1"),
        ("écrire à jean arobase exemple point fr", "email", "jean arobase exemple point fr"),
        ("an hans klammeraffe beispiel punkt de", "email", "hans klammeraffe beispiel punkt de"),
        ("a juan arroba ejemplo punto es", "email", "juan arroba ejemplo punto es"),
        ("au plus trois trois six un deux trois quatre cinq six sept huit", "phone", "plus trois trois six un deux trois quatre cinq six sept huit"),
        ("plus vier neun drei null eins zwei fünf sechs sieben acht", "phone", "plus vier neun drei null eins zwei fünf sechs sieben acht"),
        ("más tres cuatro seis uno dos cinco siete ocho nueve", "phone", "más tres cuatro seis uno dos cinco siete ocho nueve"),
    ],
)
def test_disguises(text, kind, part):
    base, both = pii.find(text)
    assert not base and [(k, text[s:e]) for k, s, e in both] == [(kind, part)]


def test_plain_prose_has_no_disguise():
    for t in ("he looked at the dot com crash", "see us at example.com", "un point sur deux", "look at the dot on the map", "one two three tests", "we met at noon. Then we left", "ŝtrange ünïcode “quotes” – dash"):
        assert pii.find(t) == ([], [])


@pytest.mark.parametrize("part", ["a dot ", "a at b dot ", "one two ", "a.b.", "1 dot ", "[at]", "a@b dot com dot ", " dot at dot at"])
def test_disguises_in_long_texts_take_linear_time(part):
    def seconds(n):
        began = time.process_time()
        pii.find(part * n)
        return time.process_time() - began

    assert seconds(40_000) < 30 * max(seconds(4_000), 0.02)


def test_pii_of_awkward_documents(docs, empty):
    got = pii.find_pii(docs).collect()
    assert len(got) == docs.count() and pii.find_pii(empty).count() == 0
    nothing = hashlib.sha256(b"").hexdigest()
    assert all(r["base_sha256"] == nothing and r["spans"] == "" for r in got)


def test_masking():
    assert pii.mask_text("a b@c.de and b [at] c [dot] de") == "a [EMAIL] and [EMAIL]"
    assert pii.mask_text(None) is None and pii.mask_text("") == ""


# op2


def shingles(t, k):
    w = (t or "").encode().lower().split()
    return {b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {b" ".join(w)} - {b""}


def linked_groups(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize("short", [2, 32])
def test_ngram_groups(spark, docs, empty, short):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = ngram_join.ngram_groups(docs, short=short, block=4).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == Counter(linked_groups(rows, 4, 85))
    assert ngram_join.ngram_groups(empty).count() == 0


def test_large_group_of_near_copies(spark):
    rng = random.Random(2)
    base = prose(rng, 120).split()
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"w{rng.randint(0, 40)}"
        rows.append((i, " ".join(w)))
    got = ngram_join.ngram_groups(spark.createDataFrame(rows, SCHEMA), short=8, block=16).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == Counter(linked_groups(rows, 4, 85))


def test_t_occurrence_search_equals_scan():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(80)]
    index = ngram_join.Index(sets)
    for q in sets:
        assert index.search(q).tolist() == [i for i, s in enumerate(sets) if ngram_join.linked(q, s)]


def test_keep_one(docs, empty):
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and ngram_join.keep_one(empty).count() == 0
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    groups = linked_groups(rows, 4, 85)
    assert {r["doc_id"] for r in kept.collect() if r["doc_id"] is not None} == {d for d, n, c in groups if d is not None and (n == 0 or d == c)}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(500, 500 + i) for i in range(300)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"))
    want = dict(components.spanning(edges))
    assert {r[0]: r[1] for r in got.collect() if r[0] != r[1]} == want


def test_parities_rule_out_no_link():
    rng = np.random.default_rng(12)
    ruled, linked = 0, 0
    for k in range(2000):
        n = int(rng.choice([1, 2, 7, 20, 64, 65, 130, 900]))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        other = np.unique(rng.integers(0, 1 << 63, 1 + n // (3, 6, 12, 20)[k % 4], dtype=np.uint64))
        b = other if k % 5 == 0 else np.unique(np.r_[a[rng.integers(0, 1 + n // 12) :], other[: rng.integers(0, len(other) + 1)]])
        may = ngram_join.may_link(len(a), len(b), ngram_join.parity_of(a), ngram_join.parity_of(b))
        is_link = ngram_join.linked(a, b)
        assert may or not is_link
        ruled, linked = ruled + (not may), linked + is_link
    assert ruled > 300 and linked > 300


def test_only_texts_of_likely_links_are_sent(spark, monkeypatch):
    rng = random.Random(21)
    shared = prose(rng, 12)
    rows = [(i, f"{shared} {prose(rng, 60)}") for i in range(40)]
    rows += [(100 + i, rows[i][1] + " end") for i in range(5)]
    sent, whole = [], ngram_join.texts_of
    monkeypatch.setattr(ngram_join, "texts_of", lambda texts, keys: sent.append(whole(texts, keys).count()) or whole(texts, keys))
    got = ngram_join.ngram_groups(spark.createDataFrame(rows, SCHEMA), short=1000).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i - 100 if i >= 100 else i for i, _ in rows}
    assert sent == [10]


# op3


def test_a_task_of_near_copies_has_one_python_worker(spark, monkeypatch):
    seen = []
    plain = {name: getattr(ngram_join, name) for name in ("verify", "connected_components")}
    for name, f in plain.items():
        monkeypatch.setattr(ngram_join, name, lambda df, *a, f=f: seen.append(df) or f(df, *a))
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join([*base[: 57 + i % 3], f"own{i}", f"mine{i}"])) for i in range(80)] + [(100 + i, " ".join(base[:40] + [f"x{i}{k}" for k in range(20)])) for i in range(40)]
    assert ngram_join.ngram_groups(spark.createDataFrame(rows, "doc_id long, text string")).count() == len(rows)
    assert len(seen) == 3  # pairs, links, and those of stars
    for df in seen:
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n")
        depth = [len(x) - len(x.lstrip(" :+-*")) for x in plan]
        for k in (k for k, x in enumerate(plan) if "InArrow" in x):
            above, d = [], depth[k]
            for j in range(k - 1, -1, -1):
                if depth[j] < d:
                    d = depth[j]
                    above.append(plan[j])
            assert any("Exchange" in x for x in above), "\n".join(plan)


def test_near_copies_are_kept_in_few_files(spark, tmp_path, monkeypatch):
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in held}
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join([*base[: 57 + i % 3], f"own{i}", f"mine{i}"])) for i in range(80)] + [(100 + i, " ".join(base[:40] + [f"x{i}{k}" for k in range(20)])) for i in range(40)]
    spark.createDataFrame(rows, SCHEMA).repartition(30).write.parquet(str(tmp_path / "documents.parquet"))
    kept, keep = [], Scratch.keep
    files = lambda path: len(list(Path(path.removeprefix("file:")).glob("part-*")))

    def counted(self, df):
        out = keep(self, df)
        kept.append(files(out._scratch_path))
        return out

    monkeypatch.setattr(Scratch, "keep", counted)
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        queries.op2_ngram_join(spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    cores = spark.sparkContext.defaultParallelism
    assert len(kept) > 8 and max(kept) <= cores and files(str(tmp_path / "out")) <= cores
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == set(linked_groups(rows, 4, 85))


def test_arc_versions():
    for version in (1, 2):
        head = warc.arc_header(version, "x.arc", "19990102030405")
        data = head + warc.arc_record(version, "http://a/b c", "19990102030405", "text/html", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody\n\n", "x.arc", len(head))
        first, second = warc.read_arc(data)
        assert (first.version, second.url, second.body[-6:]) == (version, "http://a/b c", b"body\n\n")
        (_, _), (fields, block) = warc.read_warc(warc.convert(data))
        assert fields["WARC-Type"] == "response" and fields["WARC-Date"] == "1999-01-02T03:04:05Z" and block == second.body
    assert warc.iso_date("199901") == "1999-01-01T00:00:00Z"
    with pytest.raises(ValueError, match="record line"):
        list(warc.read_arc(b"http://a 1.1.1.1 19990102030405 text/html 999\nshort"))


def test_archives(spark):
    long = "<p>" + "é" * 600
    rows = [(1, "http://a b", long), (2, None, long), (3, "u", long), (4, "", "short"), (5, "u", "short"), (6, "u", None), (None, "u", long), (3, "u", long), (7, "u", "y" * 999), (8, "u", "y" * 999)]
    df = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"), ("digest", "payload"))
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archive_pages(df).collect())
    want = Counter()
    for page, _, html in rows:
        raw = (html or "").encode()
        revisit = len(raw) >= 1000 and page != 3
        want[(page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None)] += 1
    assert got == want
    assert warc.archive_pages(df.limit(0)).count() == 0


# op4


def test_toxicity_held_out(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(1200):
        bad = rng.random() < 0.2
        w = prose(rng, 40).split()
        for _ in range(3 if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["idiot", "1d1ot!", "zorkana", "zorkani", "you MORON"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs = clashing(spark.createDataFrame([*rows, (None, None), (5000, "")], SCHEMA))
    got = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == 1202 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    truth = dict(labels)
    held = [(truth[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([a == b for a, b in held]) > 0.97
    kept = toxicity.reject_toxic(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in got)


def test_toxicity_without_labels(spark, docs):
    got = toxicity.toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len(got) == docs.count() and {r["score"] for r in got} == {0.0}


def test_isotonic_is_monotone():
    rng = np.random.default_rng(0)
    x = rng.standard_normal(500)
    knots, levels = toxicity.isotonic(x, (rng.random(500) < 1 / (1 + np.exp(-2 * x))).astype(float))
    assert (np.diff(levels) >= 0).all() and (np.diff(knots) >= 0).all()


# op5


def test_embeddings(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((60, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    for i in range(40):  # near and exact copies, and multiples
        v = x[i % 6] + (0.12 * rng.standard_normal(16) if i % 3 else 0)
        rows.append((100 + i, (v * (2 if i % 4 == 0 else 1)).astype(np.float32).tolist()))
    odd = [(200, None), (201, [0.0] * 16), (202, [float("nan")] * 16), (203, [None] * 16), (204, []), (None, rows[0][1]), (3, rows[3][1])]
    df = clashing(spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>"), ("node", "raw", "label", "n_links"))
    got = embedding_dedup.near_duplicates(df).collect()
    usable = [*rows, (None, rows[0][1]), (3, rows[3][1])]
    u = np.array([v for _, v in usable], float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    label = np.arange(len(u))
    for _ in range(len(u)):
        label = np.array([min([label[i], *label[link[i]]]) for i in range(len(u))])
    least = defaultdict(lambda: 10**9)
    for i, (k, _) in enumerate(usable):
        least[label[i]] = min(least[label[i]], k if k is not None else 10**9)
    want = Counter((k, int(link[i].sum()), least[label[i]]) for i, (k, _) in enumerate(usable))
    want += Counter((k, 0, k) for k, _ in odd[:5])
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == want
    small = embedding_dedup.near_duplicates(df, cell_rows=4, tile=4).collect()
    assert sorted(map(str, small)) == sorted(map(str, got))
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_are_sent_in_rounds(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((300, 32))
    x[150:] = x[:150] + 0.1 * rng.standard_normal((150, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    sent, write = [], common.Scratch.keep_all
    monkeypatch.setattr(common.Scratch, "keep_all", lambda self, parts: write(self, (sent.append(p) or p for p in parts)))
    plain = embedding_dedup.near_duplicates(df, cell_rows=16).collect()
    once = len(sent)
    rounds = embedding_dedup.near_duplicates(df, cell_rows=16, round_rows=300).collect()
    assert sorted(map(str, rounds)) == sorted(map(str, plain)) and len(sent) - once > once
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert {r["vec_id"]: r["n_links"] for r in rounds} == dict(enumerate(((u @ u.T >= 0.95).sum(1) - 1).tolist()))
    cells = [((8, 0, c), 10) for c in range(5)] + [((8, 1, 0), 99)]
    assert [sum(map(len, r.values())) for r in embedding_dedup.in_rounds(cells, 20)] == [2, 2, 1, 1] and embedding_dedup.in_rounds([], 20) == []


# op6


def test_leaks(spark):
    rng = random.Random(8)
    items = [(i, prose(rng, n)) for i, n in enumerate((30, 40, 45, 60, 3))] + [(9, None), (10, "")]
    rows = []
    for i in range(40):
        t = prose(rng, 120).split()
        if i % 4 == 0:
            leak = items[i % 5][1].split()
            if i % 8 == 0 and len(leak) > 40:
                leak[-1] = "other"
            t[50:50] = leak
        rows.append((i, " ".join(t).upper() if i % 3 == 0 else ", ".join(t)))
    rows += [(100, None), (101, ""), (None, items[1][1]), (102, items[4][1]), (0, rows[0][1])]
    docs = clashing(spark.createDataFrame(rows, SCHEMA))
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    grams = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    want = set()
    for d, t in rows:
        w = words(t)
        for k, it in items:
            iw = words(it)
            n = min(5, len(iw))
            if iw and any((lambda a, b: sum((a & b).values()) >= 0.8 * sum((a | b).values()) > 0)(grams(w[s : s + len(iw)], n), grams(iw, n)) for s in range(max(1, len(w) - len(iw) + 1))):
                want.add((d, k))
    got = decontamination.find_leaks(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(want) >= 10
    clean = decontamination.remove_leaks(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(d not in {x for x, _ in want} for d, _ in rows)
    assert decontamination.find_leaks(docs, bench.limit(0)).count() == 0 and decontamination.find_leaks(docs.limit(0), bench).count() == 0


def test_leaks_are_few_files(spark, tmp_path):
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in held}
    item = "how many apples did the farmer sell at the market on monday"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, f"start {i} {item} end") for i in range(60)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        queries.op6_decontamination(spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(list((tmp_path / "out").glob("part-*"))) <= spark.sparkContext.defaultParallelism
    assert sorted(r["doc_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(60))


def test_hamming_blocks(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 23)):
            b ^= 1 << bit
        rows.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    df = spark.createDataFrame(rows, "a long, b long")
    same = F.exists(F.zip_with(decontamination.hamming_blocks(F.col("a")), decontamination.hamming_blocks(F.col("b")), lambda x, y: x == y), lambda x: x)
    assert df.where(same).count() == 200


# op7


def test_passages(spark):
    rng = random.Random(10)
    shared, brief = prose(rng, 60), prose(rng, 12)
    rows = []
    for i in range(60):
        t = prose(rng, 150).split()
        t[70:70] = shared.split() if i % 6 == 0 else brief.split() if i % 6 == 1 else []
        rows.append((i, " ".join(t)))
    rows += [(100, None), (101, ""), (None, rows[2][1]), (3, rows[3][1])]
    got = substring_dedup.repeated_passages(clashing(spark.createDataFrame(rows, SCHEMA))).collect()
    found = {r["doc_id"] for r in got}
    assert {i for i in range(60) if i % 6 == 0} <= found and found <= {*range(0, 60, 6), 2} | {d for d in found if d < 0}
    for r in got:
        if r["doc_id"] % 6 == 0 and r["doc_id"] > 0:
            assert r["first_word"] <= 75 and r["end_word"] >= 125 and not r["kept"]
    assert substring_dedup.repeated_passages(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("letters", [False, True])
def test_every_short_passage_is_found(spark, letters):
    rng = random.Random(20 + letters)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 9)))
    some = lambda n: [word() for _ in range(n)] if letters else prose(rng, n).split()
    rows, want = [], {}
    for k in range(1500):
        n = 51 + k % 10
        passage = some(n) if k % 50 else ["again"] * n if k % 100 else list("ab" * 30)[:n]
        for i in (2 * k, 2 * k + 1):
            head = [f"h{i}x{j}" for j in range(rng.randint(0, 30))]
            rows.append((i, " ".join([*head, *passage, *(f"t{i}x{j}" for j in range(rng.randint(0, 30)))])))
            want[i] = (len(head), n)
    got = defaultdict(set)
    for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect():
        got[r["doc_id"]] |= set(range(r["first_word"], r["end_word"]))
    assert [i for i, (at, n) in want.items() if got[i] != set(range(at, at + n))] == []


def test_passage_of_two_common_lines(spark):
    rng = random.Random(22)
    one, two, long_one, long_two = (prose(rng, n) for n in (30, 30, 45, 45))
    own = lambda i, n=40: " ".join(f"d{i}x{k}" for k in range(n))
    rows = [(i, f"{own(i)} {(one, two)[i % 2]} {own(-i)}") for i in [*range(1, 40), *range(51, 400)]]
    rows += [(i, f"{own(i)} {one} {two} {own(-i)}") for i in (40, 50)]
    # two halves that no single other document holds side by side
    rows += [(500, f"{own(500)} {long_one} {long_two}"), *((i, f"{own(i)} {long_one} {own(-i)}") for i in (501, 502)), *((i, f"{own(i)} {long_two} {own(-i)}") for i in (503, 504))]
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["doc_id"], r["first_word"], r["end_word"], r["kept_in"]) for r in got} == {(40, 40, 100, 40), (50, 40, 100, 40)}


def test_keeper_holds_the_whole_passage(spark):
    rng = random.Random(23)
    whole = prose(rng, 100).split()
    phrase, part = " ".join(whole[40:55]), " ".join(whole[:60])
    own = lambda i: " ".join(f"d{i}x{k}" for k in range(40))
    rows = [(1, f"{own(1)} {phrase} {own(-1)}"), (5, f"{own(5)} {' '.join(whole)} {own(-5)}"), (9, f"{own(9)} {' '.join(whole)} {own(-9)}")]
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["doc_id"], r["first_word"], r["end_word"], r["kept_in"], r["kept"]) for r in got} == {(5, 40, 140, 5, True), (9, 40, 140, 5, False)}
    # document 2 holds the first 60 words: each passage lies whole in its one keeper, which keeps all of it
    rows.append((2, f"{own(2)} {part} {own(-2)}"))
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()
    texts = {i: t.split() for i, t in rows}
    kept = defaultdict(list)
    for r in got:
        if r["kept"]:
            kept[r["doc_id"]].append(" ".join(texts[r["doc_id"]][r["first_word"] : r["end_word"]]))
    for r in got:
        passage = " ".join(texts[r["doc_id"]][r["first_word"] : r["end_word"]])
        assert [i for i, held in kept.items() if any(passage in x for x in held)] == [r["kept_in"]]
    assert {r["kept_in"] for r in got} == {2, 5}


def test_chunks_resist_shifts():
    rng = random.Random(11)
    t = prose(rng, 400).encode()
    cuts = set(substring_dedup.cut_points(np.frombuffer(t, np.uint8)).tolist())
    moved = {c - 7 for c in substring_dedup.cut_points(np.frombuffer(b"insert " + t, np.uint8)).tolist()}
    assert {c for c in cuts if c > 16} <= moved


def test_only_texts_with_stretches_are_sent(spark, monkeypatch):
    rng = random.Random(31)
    passage = prose(rng, 90)
    rows = [(i, f"{prose(rng, 70)} {passage} {prose(rng, 40)}" if i in (3, 17) else prose(rng, 200)) for i in range(30)]
    sent, plans, whole, made = [], [], substring_dedup.texts_of, substring_dedup.stretches
    monkeypatch.setattr(substring_dedup, "texts_of", lambda texts, keys: sent.append(whole(texts, keys).count()) or whole(texts, keys))
    monkeypatch.setattr(substring_dedup, "stretches", lambda *a: plans.append(made(*a)) or plans[-1])
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["doc_id"], r["kept_in"], r["kept"]) for r in got} == {(3, 3, True), (17, 3, False)}
    assert all(r["n_words"] >= 90 for r in got) and sent == [2]
    assert "BroadcastHashJoin" not in plans[0]._jdf.queryExecution().executedPlan().toString()


# op8, op10


def test_token_counts(spark, docs, empty):
    import sentencepiece

    path = queries.tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    extra = spark.createDataFrame([(900, "  a  b "), (901, "▁x ▁"), (902, "<s> </s> <unk>"), (903, "\t\n \x00"), (904, "日本 語")], SCHEMA)
    both = docs.select("doc_id", "text").union(extra)
    want = Counter((r["doc_id"], len((r["text"] or "").encode()), len(sp.encode(r["text"] or ""))) for r in both.collect())
    got = token_counts.count_tokens(both, path).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
    for most in (0, 20):  # all or most pre-tokens meet their counts by exchange
        assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(both, path, frequent=most).collect()) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in got) and token_counts.count_tokens(empty, path).count() == 0


def test_packing_round_trip(spark, docs, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    extra = spark.createDataFrame([(900, "It's <|endoftext|> İ. ſt é. 3.14!"), (901, "A<|STARTOFTEXT|>b"), (902, "x\x85y\x1cz")], SCHEMA)
    both = docs.select("doc_id", "text").union(extra)
    want = Counter((r["doc_id"], tuple([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2])) for r in both.collect())
    got = packing.pack(both, path, group_docs=16).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r["ids"], "<u2").tolist()
        assert len(ids) == r["length"] and zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)) == r["ids_crc32"]
        pieces[(r["doc_id"], r["doc_tokens"])].append((r["start"], ids))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 4096
    for (d, ids), n in want.items():
        if n == 1 and sum(k[0] == d for k in want) == 1:
            assert sum((x for _, x in sorted(pieces[(d, len(ids))])), []) == list(ids)
    assert sum(n * len(ids) for (_, ids), n in want.items()) == sum(r["length"] for r in got)
    assert packing.pack(empty, path).count() == 0


def test_ids_of_every_letter_below_256():
    path = queries.tokenizer("word_bpe_49k.json")
    enc = packing.ChunkEncoder(path, 2)
    letters = [chr(c) for c in range(0x100) if chr(c).isalpha()]
    texts = [t for c in letters for t in (c, f"n{c}", f"{c}m", f"N{c}.", f"{c}{c},", f"a{c}é")]
    want = [[*enc.tok.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert [np.frombuffer(b, enc.dtype).tolist() for b in enc.encode(texts)] == want


def test_first_fit_decreasing():
    tree = packing.Tournament(5, 10)
    assert [tree.take(n) for n in (7, 6, 4, 3, 9)] == [0, 1, 1, 0, 2]
    rng = random.Random(12)
    lengths = [rng.randint(1, 300) for _ in range(200)]
    seqs = packing.pack_lengths(lengths, 100)
    assert len(seqs) == -(-sum(lengths) // 100)
    covered = Counter((i, k) for s in seqs for i, start, n in s for k in range(start, start + n))
    assert covered == Counter((i, k) for i, n in enumerate(lengths) for k in range(n))


# op9


def test_shards(spark, docs, empty):
    got = sharding.shard(docs, shards=5).collect()
    rows = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == rows
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    assert all(abs(sum(r["size"] for r in v) - total / 5) <= largest for v in by.values())
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    assert sharding.shard(empty).count() == 0


def test_hot_text_is_subdivided(spark):
    rows = [(i, "same text " * 20 if i % 3 == 0 else prose(random.Random(i), 30)) for i in range(3000)]
    got = sharding.shard(spark.createDataFrame(rows, SCHEMA)).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    sizes = [r["s"] for r in got]
    assert len(sizes) == 40 and max(sizes) - min(sizes) <= 2 * 300


def test_look_alikes_are_not_letters_of_their_own():
    assert all(ord(c) > 127 and len(p) == 1 for c, p in pii._LOOKALIKE.items())
    assert unicodedata.normalize("NFKC", "＠") == "@"


def test_archives_end_at_a_bound_of_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3_000)
    rows = [(i, f"http://h/{i}", "x" * (1_000 + i)) for i in range(20)] + [(99, "http://h/long", "y" * 300_000)]
    made = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    assert made.count() >= 6
    back = {r["page_id"]: r["payload_bytes"] for r in warc.read_archives(made).collect()}
    assert back == {i: len(h) for i, _, h in rows}
    with pytest.raises(ValueError, match="ends early"):
        list(warc.read_warc(made.first()["content"][:-5]))
