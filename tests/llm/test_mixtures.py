"""Balanced packing, token alignment and the filter audit against brute force, and on awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("ledgerloom.llm")
import public_tokenizers
from ledgerloom.llm import alignment, audit, balanced
from ledgerloom.llm.common import utf8
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

LONG = "lorem ipsum dolor, sit amet " * 4000
TEXTS = [None, "", " \n ", "a", "ALPHA beta gamma", "é" * 300, LONG, LONG, "token = abcdef AKIA <|endoftext|> <s>", "\x00 odd \t bytes 😀 " * 20, "same text here, twice over " * 9, "same text here, twice over " * 9, "x▁y", "日本語 テキスト", "#tag & $5"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, fails int, part int, pairs int, _row int, length int, rank int, ids int, digest int"


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, ("en", "fr", None)[i % 3], "s", len(t or ""), *[1] * 9) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[4], (None, *rows[6][1:]), (None, *rows[3][1:])], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pairs(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


# 11 ----------------------------------------------------------------------------------------------------------------


def held(rows, sequence=2048):
    """Tokens of each sequence; fails where places overlap, leave gaps or go beyond the end."""
    at = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert max(at.values(), default=0) <= sequence
    return at


def test_balanced_packing_places_every_token_without_padding(spark, sf_dir, corpus):
    rows = balanced.op11_balanced_packing(spark, sf_dir).collect()
    slow = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: [*slow.encode(t or "", add_special_tokens=False).ids, 1] for i, t in pairs(corpus)}
    got = defaultdict(list)
    for r in rows:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and zlib.crc32(np.array(piece, "<u4").tobytes()) == r.ids_crc32
        got[r.doc_id].append((r.start, r.length))
    assert got.keys() == ids.keys()
    for i, parts in got.items():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [s for s, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] == len(ids[i])
    full = held(rows).values()
    assert all(n == 2048 or n & (n - 1) == 0 for n in full) and sum(n < 2048 for n in full) <= 11
    assert len(rows) <= sum(-(-len(x) // 2048) for x in ids.values()) + len(full)  # a sequence cuts one piece at most


def test_balanced_packing_of_awkward_rows(awkward, empty):
    rows = balanced.pack(awkward).collect()
    slow = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sum(len(slow.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in pairs(awkward))
    assert sum(held(rows).values()) == want
    assert balanced.pack(empty).count() == 0
    for size in (1, 4, 64):  # short sequences: nearly all is cut
        rows = balanced.pack(awkward.where("doc_id not in (6, 7)"), sequence=size).collect()
        assert all(n & (n - 1) == 0 for n in held(rows, size).values())
    with pytest.raises(ValueError):
        balanced.pack(empty, sequence=1000)


def test_word_encoder_is_the_tokenizer(corpus):
    enc, draw = balanced.word_encoder(), random.Random(1)
    made = ["".join(draw.choice("ab EÀÿ'sST reLL d\n\t.,!é²½123İ日<|endoftext|>ß́ſŉ\xad\x85") for _ in range(draw.randint(0, 40))) for _ in range(2000)]
    for text in [t or "" for _, t in pairs(corpus)] + made + [t or "" for t in TEXTS]:
        assert enc.ids(text).tolist() == enc.slow.encode(text, add_special_tokens=False).ids


def greedy(counts, capacity, linear):
    """The dealing rule piece by piece: cost, room and number of the pieces of each sequence; pieces left over."""
    total = sum(n * int(c) for n, c in enumerate(counts))
    whole, rest = divmod(total, capacity)
    rooms = [capacity] * whole + [1 << b for b in range(capacity.bit_length(), -1, -1) if rest >> b & 1]
    cost, left = [0] * len(rooms), Counter()
    for n in range(len(counts) - 1, 0, -1):
        for _ in range(int(counts[n])):
            fits = [(cost[i], i) for i in range(len(rooms)) if rooms[i] >= n]
            if not fits:
                left[n] += 1
                continue
            _, i = min(fits)
            rooms[i] -= n
            cost[i] += linear * n + n * n
    return cost, left


@pytest.mark.parametrize("seed", range(12))
def test_groups_deal_as_single_pieces_do(seed):
    draw = np.random.default_rng(seed)
    capacity, linear = 64, int(draw.integers(0, 200))
    lengths = np.clip(draw.lognormal(2 + seed / 6, 1, draw.integers(1, 200)).astype(int), 1, 63)
    counts = np.bincount(lengths, minlength=capacity + 1)
    deal = balanced.Deal(counts, capacity, linear)
    cost, left = greedy(counts, capacity, linear)
    assert Counter({n: int(c) for n, c in enumerate(deal.left) if c}) == left
    got, used = Counter(), defaultdict(list)
    for n in np.flatnonzero(counts).tolist():
        for rank in range(int(counts[n])):
            if rank < deal.placed[n]:
                (s,), (o,) = deal.place(n, np.array([rank]))
                got[int(s)] += linear * n + n * n
                used[int(s)] += range(int(o), int(o) + n)
            else:
                parts = list(deal.cuts(n, rank))
                assert [p[0] for p in parts] == [0, *np.cumsum([p[1] for p in parts])[:-1]] and sum(p[1] for p in parts) == n
                for _, take, s, o in parts:
                    used[s] += range(o, o + take)
    assert sorted(got[i] for i in range(deal.sequences)) == sorted(cost)
    assert all(sorted(x) == list(range(len(x))) and (len(x) == capacity or len(x) & (len(x) - 1) == 0) for x in used.values())


def test_costs_are_balanced():
    draw = np.random.default_rng(1)
    counts = np.bincount(np.clip(draw.lognormal(5, 1, 20000).astype(int), 1, 1500), minlength=2049)
    deal, cost = balanced.Deal(counts, 2048), Counter()
    for n in np.flatnonzero(counts).tolist():
        for s in deal.place(n, np.arange(deal.placed[n]))[0] if deal.placed[n] else ():
            cost[int(s)] += balanced.LINEAR * n + n * n
    full = [c for s, c in cost.items()]
    assert deal.left.sum() < 0.05 * counts.sum()
    assert max(full) < 1.15 * np.median(full)


# 12 ----------------------------------------------------------------------------------------------------------------


def plain_alignment(texts):
    """Links and groups from whole texts, by the definition."""
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second, tool = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), alignment.default_aligner()
    found = []
    for text in texts:
        a = first.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        a_bytes, b_bytes = [tool.a_bytes[x] for x in a], [tool.b_bytes[x] for x in b]
        if not b"".join(a_bytes) == b"".join(b_bytes) == f" {text}".encode():
            found.append(([], [], [], ""))
            continue
        a_ends, b_ends = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
        both, links, groups, i, j = set(a_ends) & set(b_ends), [], [], 0, 0
        owner = [k for k, x in enumerate(b_bytes) for _ in x]
        for k, end in enumerate(a_ends):
            links += [(a[k], b[m]) for m in sorted(set(owner[end - len(a_bytes[k]) : end]))]
        for cut in sorted(both):
            x, y = a_ends.index(cut) + 1, b_ends.index(cut) + 1
            groups.append((a[i:x], b[j:y]))
            i, j = x, y
        found.append((a, b, links, ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)))
    counts = Counter(p for _, _, links, _ in found for p in set(links))
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    return [(len(a), len(b), g.count(";") + 1 if g else 0, len(ls), sum(counts[p] == most[p[0]] for p in ls), sum(counts[p] for p in ls), hashlib.sha256(g.encode()).hexdigest() if g else "") for a, b, ls, g in found]


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("broadcast_pairs", [alignment.BROADCAST_PAIRS, 0])
def test_alignment_of_awkward_rows(awkward, empty, broadcast_pairs):
    draw = random.Random(2)
    made = ["".join(draw.choice("ab eE  \n\n\t'st.,!é日😀\x00\x1c\x85\xa0　▁ <|endoftext|>lorem 123") for _ in range(draw.randint(1, 60))) for _ in range(300)]
    texts = [(i, t) for i, t in enumerate([*made, "a \n b  c\t d", " ", "\n", "a\n", "a \n", "\n a", "a\n\nb", "x "], 1000)]
    rows = [(i, t) for i, t in pairs(awkward) if i not in (6, 7) and i is not None] + texts
    frame = awkward.sparkSession.createDataFrame(rows, "doc_id long, text string")
    want = sorted(zip([i for i, _ in rows], plain_alignment([t for _, t in rows]), strict=True))
    got = sorted((r.doc_id, tuple(r[n] for n in NAMES)) for r in alignment.link_counts(frame, broadcast_pairs=broadcast_pairs).collect())
    assert got == want
    assert alignment.link_counts(awkward, broadcast_pairs=broadcast_pairs).count() == awkward.count()
    assert alignment.link_counts(empty, broadcast_pairs=broadcast_pairs).count() == 0


def test_alignment_of_the_corpus(spark, sf_dir, corpus):
    rows = [x for x in pairs(corpus)]
    want = dict(zip([i for i, _ in rows], plain_alignment([t for _, t in rows]), strict=True))
    got = {r.doc_id: tuple(r[n] for n in NAMES) for r in alignment.op12_token_alignment(spark, sf_dir).collect()}
    assert got == want


def test_units_are_the_same_by_both_ways_to_split(corpus):
    tool = alignment.default_aligner()
    for _, text in pairs(corpus):
        assert tool.split(text) == tool.units.findall(f" {text}")
        assert "".join(tool.split(text)) == f" {text}"


def test_union_find_against_a_walk():
    draw = random.Random(3)
    for _ in range(50):
        n = draw.randint(1, 40)
        edges = [(draw.randrange(n), draw.randrange(n)) for _ in range(draw.randint(0, 40))]
        least = list(range(n))
        for _ in range(n):
            for a, b in edges:
                least[a] = least[b] = min(least[a], least[b])
        one, two = (np.array(x, np.int64) for x in (zip(*edges, strict=True) if edges else ([], [])))
        assert alignment.union_find(n, one, two).tolist() == least


# 13 ----------------------------------------------------------------------------------------------------------------


def fails_of(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    return (len(words) < 100) | (100 * len(set(words)) < 80 * len(words)) << 1 | (100 * len(re.findall("[A-Z]", text)) > 10 * len(text)) << 2 | bool(re.search("[#$%&*|]", text)) << 3


def test_masks(corpus):
    draw = random.Random(4)
    texts = TEXTS + [t for _, t in pairs(corpus)] + [" ".join(draw.choice(["a", "B", "cc", "é", "Dd", "\t", "x%"]) for _ in range(draw.randint(0, 260))) for _ in range(200)]
    texts += [" ".join(f"w{i}" for i in range(n)) + tail for n in (79, 80, 99, 100) for tail in (" w0" * 20, " w0" * 25, "")]
    assert audit.masks(*utf8(pa.array(texts))).tolist() == [fails_of(t) for t in texts]


def test_words_of_one_hash_are_told_apart(monkeypatch):
    class Same(audit.SpanHash):
        def spans(self, starts, ends):
            return np.zeros(len(starts), np.uint64)

    monkeypatch.setattr(audit, "SpanHash", Same)
    texts = ["a b a", "ab cd", "", "x x x", "aa aa b"]
    raw, offsets = utf8(pa.array(texts))
    assert audit.distinct_words(raw, *audit.word_spans(raw, offsets, audit.WORD)).tolist() == [len(set(t.split())) for t in texts]


def plain_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    docs = [(lang or "", i, fails_of(text) | (i is not None and i > least[text or ""]) << 4) for i, text, lang in rows]
    out = {}
    for part in {p for p, _, _ in docs}:
        mine, share = [(i, f) for p, i, f in docs if p == part], Counter()
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, x in enumerate(order, 1):
                bit = 1 << "ABCDE".index(x)
                gone = [d for d in left if d[1] & bit]
                left = [d for d in left if not d[1] & bit]
                share[x] += len(gone)
                ids = [i for i, _ in gone]
                out[part, order, step] = [len(left), len(gone), sum(f & bit > 0 for _, f in mine) - len(gone), sum(f == bit for _, f in mine), sum(i in good for i in ids), sum(i in toxic for i in ids), x]
        for key in out:
            if key[0] == part:
                out[key][-1] = share[out[key][-1]] if isinstance(out[key][-1], str) else out[key][-1]
    return {k: tuple(v) for k, v in out.items()}


def test_audit(spark, awkward, empty, corpus):
    labels = [(1, 1, 0), (4, 1, 1), (4, 0, None), (6, None, 1), (7, 1, 0), (10, 0, 1), (11, 1, 1), (None, 1, 1), (999, 1, 1)]
    marks = spark.createDataFrame([(*x, "en", 1) for x in labels], "doc_id long, quality int, toxic int, part string, n int")
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    for frame in (awkward, corpus):
        got = {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in audit.audit(frame, marks).collect()}
        assert got == plain_audit([(r.doc_id, r.text, r.lang) for r in frame.collect()], labels)
    assert audit.audit(empty, marks).count() == 0
    assert audit.audit(awkward, marks.limit(0)).agg({"good_lost": "sum"}).first()[0] == 0


# 3 -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_program_places_nearly_all(sf_dir, sf):
    """The program's own sequences, on the lengths of the test tables."""
    import pyarrow.parquet as pq
    from ledgerloom.llm import encoder, packing

    enc = encoder.default_encoder()
    texts = pq.read_table(f"{sf_dir.rpartition('/')[0]}/{sf}/documents.parquet", columns=["text"]).column("text").to_pylist()
    counts = np.bincount([n % 1024 for n in (len(enc.ids(t or "")) + 1 for t in texts)], minlength=1025)
    counts[0] = 0
    found, by_fit, bound = packing.covering(counts, 1024, packing.LEANS[0])
    assert by_fit <= 0.1 * sum(found.values()) and bound <= sum(found.values()) <= bound + 2
    assert sum(packing.solve(counts, 1024).values()) <= sum(packing.best_fit(counts, 1024).values())


def test_priced_configurations_are_the_best():
    from itertools import combinations_with_replacement

    from ledgerloom.llm import packing

    draw = np.random.default_rng(8)
    for _ in range(20):
        price = np.where(draw.random(13) < 0.6, draw.random(13), 0.0)
        price[0] = 0
        best = max((sum(price[list(x)]) for k in range(1, 13) for x in combinations_with_replacement(range(1, 13), k) if sum(x) <= 12), default=0)
        assert abs(packing.priced(price, 12)[0][12] - best) < 1e-12
        for config, value in packing.choices(price, 12, 0.9):
            assert abs(value - best) < 1e-12 and sum(price[n] * k for n, k in config.items()) >= 0.9 * best - 1e-12 and sum(n * k for n, k in config.items()) <= 12


# 5 -----------------------------------------------------------------------------------------------------------------


def vectors_of(kind, sizes, seed=1):
    draw, rows = np.random.default_rng(seed), []
    for dim, n in sizes:
        if kind == "spread":
            x = draw.normal(size=(n, dim))
        else:
            x = draw.normal(size=(max(2, n // 25), dim))[draw.integers(0, max(2, n // 25), n)] + 0.1 * draw.normal(size=(n, dim))
        rows += [(len(rows) + i, v) for i, v in enumerate(x.tolist())]
    return rows


@pytest.mark.parametrize("kind", ["spread", "clustered"])
@pytest.mark.parametrize("sizes", [[(16, 200), (64, 200), (384, 200), (768, 500)], [(16, 3000), (384, 1500), (128, 10000)]])
def test_recall_at_any_dimension(spark, kind, sizes):
    from ledgerloom.llm import neighbours

    rows = vectors_of(kind, sizes)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(frame, frame.where("vec_id % 7 = 0")).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    at = 0
    for dim, n in sizes:
        exact = neighbours.brute_force(rows[at : at + n], 7)
        hits = [v in got[q] for q in exact for v, _ in exact[q]]
        assert sum(hits) >= 0.9 * len(hits), (dim, n, sum(hits) / len(hits))
        assert all(len(got[q]) == 10 for q in exact)
        at += n


# SQL, columns, and long texts --------------------------------------------------------------------------------------

COLUMNS = {
    "op1_token_counts": None,
    "op11_balanced_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op12_token_alignment": {"doc_id": "bigint", "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "n_best": "bigint", "count_sum": "bigint", "groups_sha256": "string"},
    "op13_filter_audit": {"part": "string", "filter_order": "string", "step": "int", "kept": "bigint", "removed": "bigint", "redundant": "bigint", "unique_fails": "bigint", "good_lost": "bigint", "toxic_lost": "bigint", "shapley": "bigint"},
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_of_queries(spark, sf_dir, name):
    from ledgerloom.llm import registry

    frame = registry.QUERIES[name](spark, sf_dir)
    assert frame.count() > 0 and dict(frame.dtypes) == (COLUMNS[name] or dict(frame.dtypes))


@pytest.mark.parametrize("name", ["op4_secrets", "op13_filter_audit"])
def test_matches_sql(spark, sf_dir, name):
    import duckdb
    from ledgerloom.llm import registry

    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    frame, want = registry.QUERIES[name](spark, sf_dir), con.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(map(tuple, frame.select(*columns).collect())) == sorted(want.fetchall())


def test_secrets_of_a_long_text_take_linear_time(spark):
    import time

    from ledgerloom.llm import secrets

    draw, took = random.Random(6), {}
    for letter in ("", "é"):
        for lines in (1000, 40000):
            text = "".join(f"{draw.getrandbits(128):032x}{letter}\n" for _ in range(lines))
            frame = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")
            began = time.time()
            found, ledger = secrets.find_secrets(frame)
            (row,) = found.collect()
            middle = time.time()
            assert [tuple(x) for x in row.spans] == [(i * (33 + len(letter)), 2, i * (33 + len(letter)) + 32) for i in range(lines)]
            assert secrets.redact(frame, ledger).first().text == f"[SECRET]{letter}\n" * lines
            took[lines] = middle - began, time.time() - middle
        assert took[40000][0] < 15 and took[40000][1] < 30, took


def test_query_reads_its_stored_ledger(spark, sf_dir, tmp_path):
    from ledgerloom.llm import registry, secrets

    spark.conf.set(secrets.LEDGER_SETTING, str(tmp_path / "ledger"))
    try:
        first = sorted(map(tuple, registry.QUERIES["op4_secrets"](spark, sf_dir).collect()))
        size = spark.read.parquet(str(tmp_path / "ledger")).count()
        second = sorted(map(tuple, registry.QUERIES["op4_secrets"](spark, sf_dir).collect()))
        assert first == second and spark.read.parquet(str(tmp_path / "ledger")).count() == size
    finally:
        spark.conf.unset(secrets.LEDGER_SETTING)
