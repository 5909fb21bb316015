"""Shared search, spelling variants and archives against brute force, with nulls, empty and repeated rows, empty tables
and clashing extra columns."""

import base64
import glob
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from parcelry.llm import op2_secrets, op4_kd_shards, op5_toxicity, op10_decontaminate, op11_shared_search, op12_spelling_variants, op13_warc_revisits
from tests.llm.test_llm import DOCS, LOWER, frame

ITEMS = "item_id long, text string, block string, plan string, term string, rank string, score string, doc_id string"


def items_frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "x", "x", "x", "x", "x") for i, t in rows], ITEMS).repartition(2)


def search_by_hand(rows, items, top):
    term = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    docs = [(r[0], Counter(term(r[1]))) for r in rows if term(r[1])]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, own in sorted({(i, tuple(sorted(term(t)))) for i, t in items}, key=repr):
        found = []
        for doc, c in docs:
            m = 100 - 25 + (25 * sum(c.values()) * n) // total
            found.append((-sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in own), doc is None, doc))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, k, doc, -s) for k, (s, _, doc) in enumerate(found[:top], 1) if s < 0]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def search_case():
    rng = random.Random(11)
    vocabulary = [f"Term{i}" for i in range(60)] + ["é×ü", "x y", "CaSe", "1a2"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    rows = [(i, rng.choice([" ", "-", "\t", "_"]).join(rng.choices(vocabulary, weights, k=rng.choice([1, 5, 30, 200]))), f"s{i % 3}") for i in range(80)]
    rows += [(90, None, None), (91, "", "s"), (92, " -_!", "s"), (93, rows[3][1], "s"), (93, rows[3][1], "s"), (None, rows[3][1], "s"), (None, rows[3][1], "s"), (94, "case " * 50_000, "s")]
    items = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.choice([2, 8, 40])))) for i in range(25)]
    items += [(50, None), (51, "..."), (52, "nowhere"), (53, "case CASE case"), (54, items[0][1]), (0, items[0][1]), (None, "term1 term2")]
    return rows, items


@pytest.mark.parametrize("size", [100_000, 60])
def test_shared_search_equals_brute_force(spark, search_case, size, monkeypatch):
    monkeypatch.setattr(op11_shared_search, "BLOCK_TERMS", size)  # one block, or several
    monkeypatch.setattr(op11_shared_search, "CELLS", 2_000)  # several steps a batch
    rows, items = search_case
    for top in (3, 20, 500):
        got = op11_shared_search.shared_search(frame(spark, rows), items_frame(spark, items), top).collect()
        assert sorted((tuple(r) for r in got), key=repr) == search_by_hand(rows, items, top)


def test_shared_search_without_rows(spark, search_case):
    rows, items = search_case
    for docs, queries in (([], items), (rows, []), ([(1, None, None)], items), (rows, [(1, "")])):
        assert op11_shared_search.shared_search(frame(spark, docs), items_frame(spark, queries)).collect() == []


def test_shared_sums_are_made_once():
    rng = random.Random(3)
    common = [f"t{k}".encode() for k in range(12)]
    items = [(i, rng.sample(common, 9) + [f"own{i}".encode()] * (i % 3)) for i in range(30)]
    plan = op11_shared_search.Plan(items)
    weights = np.arange(len(plan.terms) * 2, dtype=np.int64).reshape(-1, 2) ** 2
    number = {t: k for k, t in enumerate(plan.terms)}
    assert plan.scores(weights).tolist() == [sum(weights[number[t]] for t in terms).tolist() for _, terms in items]
    assert plan.levels and plan.adds < 0.6 * plan.plain_adds
    operands = {k: (a, b) for level in plan.levels for k, a, b in level.tolist()}
    held = Counter(plan.item_nodes.tolist()) + Counter(n for pair in operands.values() for n in pair)
    assert set(operands) <= set(held)  # no sum is made in vain


def test_search_query_equals_its_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = op11_shared_search.op11_shared_search(spark, sf).collect()
    assert sorted((tuple(r) for r in got), key=repr) == search_by_hand(docs, items, 20)


def variants_by_hand(rows):
    counts = Counter()
    for r in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", r[1] or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def is_near(u, v):
        if len(u) > len(v):
            u, v = v, u
        if len(u) == len(v):
            return sum(x != y for x, y in zip(u, v, strict=True)) == 1
        return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))

    near = {u: [v for v in words if is_near(u, v)] for u in words}
    form = {}
    for u, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[u] = best if best is not None and words[best] >= 2 * words[u] else None

    def root(u):
        return u if form[u] is None else root(form[u])

    return sorted(((u, form[u], root(u), words[u], len(near[u]), words.get(form[u])) for u in words), key=repr)


@pytest.fixture(scope="module")
def spelled():
    rng = random.Random(12)
    stems = ["aaaaa", "aaaaaa", "aaaaaaa", "banane", "BANANEN", "straße", "straßen", "été×éé", "hello", "hallo", "hellooo", "xyzzy"]
    letters = "abné÷"
    pool = list(stems)
    for s in stems:
        for _ in range(25):
            i = rng.randrange(len(s) + 1)
            pool.append(rng.choice([s[:i] + rng.choice(letters) + s[i:], s[:i] + s[i + 1 :], s[:i] + rng.choice(letters) + s[i + 1 :]]))
    pool += ["".join(rng.choices("ab", k=rng.choice([4, 5, 6, 7, 8]))) for _ in range(300)]
    rows = [(i, rng.choice([" ", "-", "1"]).join(rng.choices(pool, [1 / (k % 40 + 1) for k in range(len(pool))], k=120)), "s") for i in range(60)]
    long = "".join(rng.choices("abc", k=5_000))
    rows += [(70, None, "s"), (71, "", "s"), (72, "1 2 ,", "s"), (73, rows[0][1], "s"), (73, rows[0][1], "s"), (None, rows[1][1], "s"), (74, " ".join([long] * 3 + [long + "x"] * 7 + ["q" + long] * 14), "s"), (75, "plural " * 40_000, "s")]
    return rows


@pytest.mark.parametrize("most", [20_000, 7])
def test_spelling_variants_equal_brute_force(spark, spelled, most, monkeypatch):
    monkeypatch.setattr(op12_spelling_variants, "MOST", most)  # groups whole, or parted again and again
    monkeypatch.setattr(op12_spelling_variants, "HELD", 100)
    got = op12_spelling_variants.spelling_variants(frame(spark, spelled)).collect()
    by_hand = variants_by_hand(spelled)
    assert sorted((tuple(r) for r in got), key=repr) == by_hand
    assert sum(r[1] is not None for r in by_hand) > 50 and any(r[2] not in (r[0], r[1]) for r in by_hand)


def test_spelling_variants_without_words(spark):
    for rows in ([], [(1, None, None)], [(1, "abcd abcd abcd", "s")], [(1, "single words only here", "s")]):
        assert op12_spelling_variants.spelling_variants(frame(spark, rows)).collect() == []


def test_acceptor_is_minimal_and_composes_once():
    words = sorted({a + b + c for a in ("t", "s", "") for b in ("op", "ops", "oop") for c in ("", "s", "ped")})
    machine = op12_spelling_variants.Acceptor(words)
    open_, accepted, reached = [(0, "")], [], set()
    while open_:
        p, s = open_.pop()
        reached.add(p)
        accepted += [s] * machine.final[p]
        open_ += [(q, s + c) for c, q in machine.moves[p].items()]
    assert sorted(accepted) == words

    def rest(p):
        return frozenset([""] * machine.final[p] + [c + s for c, q in machine.moves[p].items() for s in rest(q)])

    assert len({rest(p) for p in reached}) == len(reached)  # no two states accept the same
    for n in range(2, 8):
        pairs = machine.near(n, True)
        by_hand = [(u, v) for u in words for v in words if len(u) == n and ((len(v) == n and u < v and sum(x != y for x, y in zip(u, v, strict=True)) == 1) or (len(v) == n + 1 and any(v[:i] + v[i + 1 :] == u for i in range(n + 1))))]
        assert sorted(pairs) == sorted(by_hand)


def test_variants_query_equals_its_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    docs_frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted((tuple(r) for r in op12_spelling_variants.spelling_variants(docs_frame).collect()), key=repr) == variants_by_hand(docs)
    assert op12_spelling_variants.op12_spelling_variants(spark, sf).columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_counts_are_handed_on_in_parts(monkeypatch):
    monkeypatch.setattr(op12_spelling_variants, "HELD", 2)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, None]), pa.array(["alpha beta- Gamma delta", "alpha alpha omega", None])], ["doc_id", "text"])
    parts = list(op12_spelling_variants._counted([batch, batch]))
    total = Counter()
    for p in parts:
        total.update(dict(zip(p.column(0).to_pylist(), p.column(1).to_pylist(), strict=True)))
    assert len(parts) > 2 and total == {"alpha": 6, "gamma": 2, "delta": 2, "omega": 2}


PAGES = "page_id long, url string, html string, digest string, file string, content string, n string, to string"


def pages_frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "x", "x", "x", "x") for i, u, h in rows], PAGES).repartition(3)


def revisits_by_hand(rows, min_bytes=0):
    groups = {}
    for i, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(i)
    out = []
    for payload, ids in groups.items():
        ids.sort(key=lambda i: (i is not None, i or 0), reverse=True)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        for k, i in enumerate(ids):
            again = k > 0 and len(payload) >= min_bytes
            out.append((i, len(payload), digest, "revisit" if again else "response", ids[0] if again else None))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def page_rows():
    rng = random.Random(13)
    bodies = ["<p>one</p>", "é\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", "", "x" * 300_000, "HTTP/1.1 200 OK\r\n\r\nbody", "\0\n\0"]
    rows = [(i, f"http://e.org/{i}?q=é\r\nA: b", rng.choice(bodies)) for i in range(60)]
    rows += [(i, "http://hot.org", "the hot page") for i in range(100, 140)] + [(i, None, f"own {i}") for i in range(200, 230)]
    rows += [(300, "u", None), (None, None, None), (None, "u", "<p>one</p>"), (301, "u", "twice"), (301, "u", "twice"), (None, "v", "nobody"), (None, "w", "nobody"), (-5, "n", "nobody")]
    return rows


@pytest.mark.parametrize(("sent", "min_bytes", "archive"), [(20_000, 0, 64 << 20), (0, 11, 2_000)])
def test_revisits_equal_brute_force(spark, page_rows, sent, min_bytes, archive, monkeypatch):
    monkeypatch.setattr(op13_warc_revisits, "SENT", sent)  # changes sent to all tasks, or joined by a shuffle
    got = op13_warc_revisits.page_revisits(pages_frame(spark, page_rows), min_bytes, archive_bytes=archive).collect()
    assert sorted((tuple(r) for r in got), key=repr) == revisits_by_hand(page_rows, min_bytes)


def test_no_pages(spark):
    assert op13_warc_revisits.page_revisits(pages_frame(spark, [])).collect() == []


def test_archives_hold_what_they_say(spark, page_rows, tmp_path):
    op13_warc_revisits.write_pages(pages_frame(spark, page_rows), f"{tmp_path}/a", archive_bytes=50_000)
    op13_warc_revisits.deduplicate(spark, f"{tmp_path}/a", f"{tmp_path}/b", archive_bytes=50_000)
    held = {}
    for top in "ab":
        files = glob.glob(f"{tmp_path}/{top}/part-*")
        assert len(files) > 3
        held[top] = [r for f in files for r in op13_warc_revisits.records(open(f, "rb").read())]
    payloads = sorted(op13_warc_revisits.parted(*r)[1] for r in held["a"])
    assert payloads == sorted((h or "").encode() for _, _, h in page_rows)
    responses = {f["warc-record-id"]: (f, op13_warc_revisits.parted(f, b)[1]) for f, b in held["b"] if f["warc-type"] == "response"}
    again = [f for f, _ in held["b"] if f["warc-type"] == "revisit"]
    assert sorted(p for _, p in responses.values()) == sorted(set(payloads)) and len(again) == len(payloads) - len(responses)
    assert not {f["warc-record-id"] for f, _ in held["a"]} & {f["warc-record-id"] for f, _ in held["b"]}
    for f in again:
        to, payload = responses[f["warc-refers-to"]]
        assert f["warc-payload-digest"] == to["warc-payload-digest"] == "sha1:" + op13_warc_revisits.digest_of(payload)
        assert f["warc-refers-to-target-uri"] == to["warc-target-uri"] and f["warc-profile"] == op13_warc_revisits.PROFILE
    assert sorted(responses[f["warc-refers-to"]][1] for f in again) == sorted((Counter(payloads) - Counter(set(payloads))).elements())


def test_foreign_archives(spark, tmp_path):
    made, digest = op13_warc_revisits.record, op13_warc_revisits.digest_of
    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n"
    response = lambda n, payload, date: made([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:{n}>"), ("WARC-Date", date), ("WARC-Target-URI", f"http://{n}"), ("Content-Type", "application/http; msgtype=response")], http + payload)
    older = made([("WARC-Type", "revisit"), ("WARC-Record-ID", "<urn:r>"), ("WARC-Date", "2019"), ("WARC-Payload-Digest", f"sha1:{digest(b'same').lower()}"), ("WARC-Refers-To", "<urn:1>"), ("Content-Type", "application/http")], http)
    lost = made([("WARC-Type", "revisit"), ("WARC-Record-ID", "<urn:l>"), ("WARC-Payload-Digest", "sha1:ELSEWHERE"), ("WARC-Refers-To", "<urn:elsewhere>"), ("Content-Type", "application/http")], http)
    info = made([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:i>"), ("Content-Type", "application/warc-fields")], b"software: x\r\n")
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "plain.warc").write_bytes(info + response(1, b"same", "2020") + older)
    (tmp_path / "a" / "whole.warc.gz").write_bytes(gzip.compress(response(2, b"same", "2021") + lost))
    (tmp_path / "a" / "empty.warc").write_bytes(b"")
    op13_warc_revisits.deduplicate(spark, f"{tmp_path}/a", f"{tmp_path}/b")
    fresh = op13_warc_revisits.fresh_id
    rows = {r.record_id: r for r in op13_warc_revisits.index(spark, f"{tmp_path}/b").collect()}
    assert {k: (r.kind, r.refers_to) for k, r in rows.items()} == {
        fresh("<urn:i>"): ("warcinfo", None), fresh("<urn:1>"): ("revisit", fresh("<urn:2>")), fresh("<urn:2>"): ("response", None), fresh("<urn:r>"): ("revisit", fresh("<urn:2>")), fresh("<urn:l>"): ("revisit", "<urn:elsewhere>"),
    }
    assert sorted((r.payload_bytes, r.record_type) for r in op13_warc_revisits.resolved(spark, f"{tmp_path}/b").fillna(-1).collect()) == [(-1, "revisit"), (4, "response"), (4, "revisit"), (4, "revisit")]
    with pytest.raises(ValueError, match="breaks off"):
        list(op13_warc_revisits.records(info[:-10]))
    with pytest.raises(ValueError, match="no record"):
        list(op13_warc_revisits.records(b"hello\r\n"))


# ---- registered queries of earlier operators, over a whole given table ------------------------------------------------

SF = "/root/testdata/sf0.001"


def given(spark, table, sf=SF):
    return [r.asDict() for r in spark.read.parquet(f"{sf}/{table}.parquet").collect()]


def test_secret_query_digests(spark):
    """The query's base columns by the plain patterns; every span of it is inside its text and digests to the same."""
    patterns = (
        ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24),
    )
    got = {r["doc_id"]: r for r in op2_secrets.op2_entropy_secrets(spark, SF.replace("0.001", "0.01")).collect()}
    docs = given(spark, "documents", SF.replace("0.001", "0.01"))
    assert len(got) == len(docs)
    for d in docs:
        spans = []
        for k, (name, pattern, group, least) in enumerate(patterns):
            # letters of the names in either case, but no other letter that folds to them
            found = [m for m in re.finditer(pattern, d["text"] or "", re.ASCII if name == "assign" else 0) if len(m[group]) >= least]
            spans += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in found]
        r, base = got[d["doc_id"]], ",".join(s for _, _, s in sorted(spans))
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == i for _, k, _ in spans) for i in range(3))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        listed = [s.split(":") for s in r["spans"].split(",") if s]
        assert [s for s in r["spans"].split(",") if s and not s.startswith("entropy")] == [s for _, _, s in sorted(spans)]
        assert all(0 <= int(a) < int(b) <= len(d["text"]) for _, a, b in listed)
    assert sum(r["n_assign"] + r["n_access"] + r["n_hex"] for r in got.values()) > 0


def test_shard_query_keeps_its_law(spark):
    got, docs = op4_kd_shards.op4_kd_tree_shards(spark, SF).collect(), given(spark, "documents")
    facts = lambda text: (len((text or "").encode()) + 1, zlib.crc32((text or "").encode()))
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted((d["doc_id"], *facts(d["text"])) for d in docs)
    assert {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)}
    sizes, slots, shards = Counter(), {}, {}
    texts = {d["doc_id"]: d["text"] for d in docs}
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        shards.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert sorted(sizes) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r["size"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= max(2 * largest, 0.1 * sum(sizes.values()) / 8)
    assert max(len(s) for s in shards.values()) == 1


def test_toxicity_query_against_a_plain_machine(spark):
    """Scores of the query are those of the trained model applied text by text, whatever batch a text comes in, and don't
    depend on ids or other columns."""
    got = {r["doc_id"]: r for r in op5_toxicity.op5_subsequence_svm(spark, SF).collect()}
    docs = given(spark, "documents")
    assert len(got) == len(docs)
    model = op5_toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    reader = op5_toxicity.Reader(model.kernel)
    for d in docs:
        r = got[d["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert abs(r["score"] - float(op5_toxicity._scores(model, pa.array([d["text"]], pa.string()), reader)[0])) < 1e-6
    same = {}
    for d in docs:
        same.setdefault(d["text"], set()).add(round(got[d["doc_id"]]["score"], 9))
    assert all(len(s) == 1 for s in same.values())


def test_one_overlap_is_enough_to_go():
    """A sentence that many items share: a text that holds it is found once, not once for each of them."""
    rng = random.Random(10)
    shared = [rng.getrandbits(62) for _ in range(20)]
    seeds = op10_decontaminate.Seeds([(i, shared + [rng.getrandbits(62) for _ in range(10)]) for i in range(300)])
    texts = [[rng.getrandbits(62) for _ in range(30)] + (shared if k % 2 else []) for k in range(6)]
    h, at = np.array([w for t in texts for w in t], np.int64).view(np.uint64), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    every, some = seeds.hits(h, at, 0.7), seeds.hits(h, at, 0.7, any_item=True)
    assert {r for r, *_ in every} == {r for r, *_ in some} == {1, 3, 5} and len(every) == 900 and len(some) == 3


def test_any_overlap_loses_no_document():
    rng = random.Random(20)
    vocabulary = list(range(1, 40))
    for _ in range(30):  # few words, so seeds meet many items, most of which don't overlap
        items = [(i, rng.choices(vocabulary, k=rng.choice([4, 12, 20, 30]))) for i in range(40)]
        texts = []
        for _ in range(12):
            own = list(rng.choice(items)[1])
            own = [rng.choice(vocabulary) if rng.random() < rng.choice([0, 0.2, 0.4]) else w for w in own]
            texts.append(rng.choices(vocabulary, k=rng.randrange(30)) + own[: rng.randrange(len(own) + 1)] + rng.choices(vocabulary, k=rng.randrange(30)))
        seeds = op10_decontaminate.Seeds([(i, [w * 0x1234567 for w in x]) for i, x in items])
        h, at = np.array([w * 0x1234567 for t in texts for w in t], np.int64).view(np.uint64), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        every, some = seeds.hits(h, at, 0.7), seeds.hits(h, at, 0.7, any_item=True)
        assert {r for r, *_ in every} == {r for r, *_ in some} and len(some) == len({r for r, *_ in some})
