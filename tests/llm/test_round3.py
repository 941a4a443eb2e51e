"""SentencePiece chunks, fill-in-the-middle ropes and the Merkle manifest against the library and plain versions."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketlens.llm import attention, copies, fim, lm, manifest, pieces, queries, segments, suffixes
from tests.llm.test_operators import plain_dedup

TEXTS = [
    (1, "Hello  World, don't STOP 42!!"), (2, None), (3, ""), (4, " \t\n"), (5, "x" * 5000), (6, "ab " * 3000), (7, "日本語 é ß ▁x <s></s><unk><0x41>\r\n　\x00"), (8, "the quick brown fox " * 12000), (9, "   lead and trail   "),
    (9, "   lead and trail   "), (None, "null id"), (10, "<P>has a sentinel<M>"), (11, "▁"), (12, "line one\nline two\n\n\tline three"), (-3, "negative"), (13, "z" * 70 + " " + "é" * 200),
]
MODEL = queries.vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    """Awkward texts, with columns that the operators use themselves or name their results by."""
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}" if k % 4 else None, k, "own", "own", 7, "tree") for k, (i, t) in enumerate(TEXTS)], "doc_id bigint, text string, lang string, source string, n_chars bigint, pieces string, fim string, pos int, tree string")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_pieces_match_the_library(spark, docs, library):
    for r in pieces.encode(docs, MODEL).collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        assert (r.pieces.n_tokens, bytes(r.pieces.ids), r.pieces.decoded) == (len(ids), struct.pack(f"<{len(ids)}I", *ids), library.decode(ids))
        assert (r.fim, r.pos, r.tree) == ("own", 7, "tree")
    assert pieces.encode_digest(docs.where("false"), MODEL).count() == 0
    digest = {r.doc_id: r.pieces for r in pieces.encode_digest(docs.where("doc_id = 12"), MODEL).collect()}
    ids = library.encode(dict(TEXTS)[12], add_bos=True, add_eos=True)
    assert digest[12].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest() and digest[12].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


@pytest.mark.parametrize("memo", [pieces.MEMO, 5])
def test_pieces_random_texts(monkeypatch, library, memo):
    monkeypatch.setattr(pieces, "MEMO", memo)
    monkeypatch.setattr(pieces, "GATHER", 50)
    rng, model = random.Random(1), pieces.PieceModel(MODEL)
    table, pool = pieces.ChunkTable(model), "ab the ing  ▁XYZ \n\t0123 éß日本🙂　 �\x00<s></s><0x41> ’"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 80))) for _ in range(1500)] + [None, "", " ", "  ", "▁", "   a", " " * 40]
    for at in range(0, len(texts), 37):
        for text, ids in zip(texts[at : at + 37], table.encode(pa.array(texts[at : at + 37], pa.string()))):
            assert list(ids) == library.encode(text or "", add_bos=True, add_eos=True) and model.decode(ids) == library.decode(list(map(int, ids)))
    for _ in range(1500):
        ids = [rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(300) for _ in range(rng.randint(0, 12))]
        assert model.decode(np.array(ids, int)) == library.decode(ids)


def test_pieces_long_words_merge_alike(monkeypatch):
    model, rng = pieces.PieceModel(MODEL), random.Random(4)
    words = ["".join(rng.choice("theaniog1") for _ in range(rng.randint(2, 60))) for _ in range(300)]
    short = [model.parts(w) for w in words]
    monkeypatch.setattr(pieces, "SHORT", 1)
    assert [model.parts(w) for w in words] == short


def draws_of(doc_id):
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in range(0, 32, 8)]


def plain_fim(text, d):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or d[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((d[0] % (n + 1), d[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if d[3] % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fim_query_columns(spark, docs):
    done = fim.transform(docs.drop("fim")).withColumn("back", fim.restore(F.col("fim.output"), F.col("fim.form")))
    got = Counter((r.doc_id, *r.fim, r.back, r.pos) for r in done.collect())
    assert got == Counter((i, *plain_fim(t or "", draws_of(i)), t or "", 7) for i, t in TEXTS)
    assert fim.transform(docs).select("fim.form").distinct().count() > 1 and fim.transform(docs.where("false")).count() == 0


@pytest.mark.parametrize("leaf", [1, 3, 7, fim.LEAF])
def test_fim_ropes(monkeypatch, leaf):
    monkeypatch.setattr(fim, "LEAF", leaf)
    rng = random.Random(leaf)
    for _ in range(1500):
        text, d = "".join(rng.choice("abAZ<PSM>é日\n 🙂1[`{@") for _ in range(rng.randint(0, 60))), [rng.getrandbits(32) for _ in range(4)]
        got = fim.rearranged(text, d)
        assert got == plain_fim(text, d) and fim.restored(got[4], got[1]) == text
        tree, at = fim.rope(text), rng.randint(0, len(text))
        assert tuple(map(fim.text_of, fim.split(tree, at, "chars"))) == (text[:at], text[at:]) and (tree.units, tree.chars) == (got[0], len(text))


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def shown(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels_of(nodes):
    """The levels of a tree, each a list of hashes; the last has one."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def path_of(levels, at):
    for nodes in levels[:-1]:
        run = at // 16 * 16
        yield nodes[run:at], nodes[at + 1 : run + 16]
        at //= 16


def plain_manifest(rows):
    leaf = lambda r, text: H(*(shown(v) for v in (r[0], r[1], r[2], r[3], text)))
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    order = {s: sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4]))) for s in names}
    trees = {s: levels_of([leaf(r, r[4]) for r in order[s]]) for s in names}
    top = levels_of([trees[s][-1][0] for s in names])
    for k, s in enumerate(names):
        for i, r in enumerate(order[s]):
            path = [*path_of(trees[s], i), *path_of(top, k)]
            bad = zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 5 == 0
            text = r[4].translate({c: c + 32 for c in range(65, 91)}) if bad and r[4] is not None else r[4]
            folded = leaf(r, text)
            for left, right in path:
                folded = H(*left, folded, *right)
            yield r[0], leaf(r, r[4]), trees[s][-1][0], top[-1][0], H(*(x for left, right in path for x in (*left, *right))), folded, folded == top[-1][0]


def test_manifest_of_awkward_rows(spark, docs):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    rows += [(9, None, None, None, None), (9, None, None, None, None), (None, "", "", 0, "A"), (0, "é", "x", 1, "UP"), (0, "Z", "x", 1, "UP")]
    names = "doc_id bigint, source string, lang string, n_chars bigint, text string"
    given = spark.createDataFrame(rows, names).withColumns({c: F.lit("own") for c in ("tree", "hash", "present", "pos", "size", "part", "block")})
    got = Counter(tuple(r) for r in manifest.manifest(given, manifest.tampered()).collect())
    assert got == Counter(plain_manifest(rows))
    clean = manifest.manifest(given).collect()
    assert len(clean) == len(rows) and all(r.verified for r in clean)
    assert manifest.manifest(given.where("false"), manifest.tampered()).count() == 0
    one = manifest.manifest(given.where("source = 'Z'")).collect()
    assert [(r.leaf == r.subroot == r.root, r.proof_sha256) for r in one] == [(True, H())]


def test_manifest_blocks_and_rounds(spark):
    """A hot source of several blocks, and more small sources than a run holds."""
    rows = [(i, "hot" if i % 3 else f"s{i % 120}", "en", i, f"Text {i}") for i in range(1500)]
    got = Counter(tuple(r) for r in manifest.manifest(spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string"), manifest.tampered()).collect())
    assert got == Counter(plain_manifest(rows))


def test_manifest_tables_are_of_whole_blocks(monkeypatch):
    monkeypatch.setattr(manifest, "ROWS", 10)
    tree, block = [t for t in "aabc" for _ in range(7)], [b for b in (0, 1, 1, 0) for _ in range(7)]
    rows = pa.table({"tree": tree, "block": block, "pos": range(28)})
    for size in (1, 3, 9, 28):
        parts = list(manifest.whole_blocks(iter(rows.to_batches(size))))
        assert pa.concat_tables(parts).to_pydict() == rows.to_pydict()
        keys = [set(zip(p["tree"].to_pylist(), p["block"].to_pylist())) for p in parts]
        assert sum(map(len, keys)) == 4 and all(len(p) for p in parts)


def test_segments_of_many_texts_are_few_rows(spark):
    """A passage in every text of a slice is a row with all its places, and each place loses it."""
    rng = np.random.default_rng(9)
    letters = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    shared = letters(400)
    rows = [(i, letters(int(rng.integers(100, 300))) + shared + letters(150)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    texts = suffixes._named(docs, "text")
    got = suffixes.suffix_arrays(texts, suffixes.LENGTH, 1).collect()
    names = {r.t1: r.text.encode() for r in texts.collect()}
    places = Counter((r.key, r.seg, p.t1, p.lo, p.hi) for r in got for p in [r, *(r.more or ())])
    assert places == Counter((int(k), int(s), t1, int(a), int(b)) for t1, t in names.items() for k, s, a, b in zip(*segments.segments(t)))
    assert len(got) == len({(r.key, r.seg) for r in got}) and all(r.n == 1 + len(r.more or ()) for r in got) and max(r.n for r in got) == 300
    kept = {r.doc_id: bytes(r.dedup.kept).decode() for r in suffixes.dedup(docs).collect()}
    assert kept == {i: x[3].decode() for (i, _), x in zip(rows, plain_dedup([t for _, t in rows], suffixes.LENGTH))}
    assert all(shared[10:-10] not in t for t in kept.values())


def test_a_common_passage_gives_a_row_for_each_text(spark):
    """What every text shares leaves each of them in one row of merged ranges, so rows follow texts, not places."""
    rng = np.random.default_rng(10)
    letters = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    first, second = letters(1500), letters(900)
    for n in (60, 240):
        lines = [letters(120) + first + letters(30 + i % 7) + second + letters(90) for i in range(n)]
        texts = suffixes._named(spark.createDataFrame([(t,) for t in lines], "text string").coalesce(2), "text")
        got = suffixes.repeats(texts).collect()
        # One row, and those of the segments at the four edges of the passages, which are compared window by window.
        assert n <= len(got) <= 6 * n
        names = {(r.t1, r.t2): r.text.encode() for r in texts.collect()}
        lost: dict = {k: set() for k in names}
        for r in got:
            for x in r.ranges:
                lost[r.t1, r.t2].update(range(x >> 32, x & 0xFFFFFFFF))
        plain = plain_dedup(lines, suffixes.LENGTH)
        kept = sorted(bytes(c for i, c in enumerate(t) if i not in lost[k]) for k, t in names.items())
        assert kept == sorted(x[3] for x in plain)


def test_near_copies_are_found_by_fingerprints(spark, monkeypatch):
    """SimHash with its pivot tables brings copies together; the texts decide, and MinHash finds what is further apart."""
    rng = np.random.default_rng(12)
    base = [[f"w{x}" for x in rng.integers(0, 4000, 300)] for _ in range(12)]
    lines = [" ".join(w) for w in base]
    lines += [" ".join([*w[:150], f"new{i}", *w[151:]]) for i, w in enumerate(base)]
    docs = spark.createDataFrame(list(enumerate(lines)), "k bigint, t string")
    fps = [copies.fingerprint(copies.shingles(copies._line(t.encode()))) for t in lines]
    near = {i for i in range(12) if ((fps[i] ^ fps[12 + i]) & (2**64 - 1)).bit_count() <= 4}
    assert len(near) >= 3
    nodes = docs.select(F.col("k").alias("node"), "t")
    marked = nodes.mapInArrow(copies._keyed, "node bigint, n int, fp bigint, keys array<bigint>")
    pairs = {(r.a, r.b) for r in copies.verified(copies.simhash_pairs(marked.select("node", "fp")), nodes).collect()}
    assert pairs == {(i, 12 + i) for i in near}
    seen, plain = [], copies.simhash.near_links
    monkeypatch.setattr(copies.simhash, "near_links", lambda rows, *a: (seen.append(rows.count()), plain(rows, *a))[1])
    got = {r.k: r.component_id for r in copies.near_copies(docs, "t", "k").collect()}
    assert got == {i: i % 12 for i in range(24)} and seen == [len(set(fps))]


def test_attention_trains_one_vector():
    """Adam over one vector of all weights gives what Adam of each array gives, and leaves the start alone."""
    r = np.random.default_rng(3)
    win, goal = attention.windows(r.integers(0, 8, 3000).astype(np.uint8), np.array([0, 1000, 3000]), 0)
    start = attention.fresh(8, np.ones((8, 8)))
    before = attention.pack(start)
    got = attention.train(start, win, goal, 0.02, 16)
    assert len({id(got[n].base) for n in attention.NAMES}) == 1 and got["q"].base.size == len(before) // 4 and attention.pack(start) == before
    want = {n: x.copy() for n, x in start.items()}
    first, second = ({n: np.zeros_like(x) for n, x in want.items()} for _ in range(2))
    order, steps = np.random.default_rng(5).permutation(len(win)), -(-len(win) // 16)
    for t in range(steps):
        at = order[t * 16 : (t + 1) * 16]
        _, g = attention.gradient(want, win[at], goal[at])
        for n in attention.NAMES:
            first[n] = 0.9 * first[n] + 0.1 * g[n]
            second[n] = 0.99 * second[n] + 0.01 * g[n] ** 2
            want[n] -= 0.02 * (1 - t / steps) * (first[n] / (1 - 0.9 ** (t + 1))) / (np.sqrt(second[n] / (1 - 0.99 ** (t + 1))) + 1e-8)
    assert all(np.allclose(got[n], want[n], atol=1e-4) for n in attention.NAMES)


def test_lm_looks_each_word_of_a_slice_up_once():
    """Words are split and told apart in Arrow; what comes out is what the plain split gives, white space of all kinds included."""
    lines = ["", " ", "a  b\t\nc ", "\x0bA\x0cB\r", "É Ü x İ", "\x1c\x85 z z", "a\x00b a A a", None, "b b b"]
    plain = [lm.words_of((t or "").encode()) for t in lines]
    words = sorted({w for ws in plain for w in ws})
    asked: list[bytes] = []

    class Spied(lm.Lexicon):
        def codes(self, words):
            asked.extend(words)
            return super().codes(words)

    for known in (words, words[::2], []):
        lex = Spied(queries.vocabulary(), np.arange(lm.IDS) % 128, known, bytes(i % 128 for i in range(len(known))), np.arange(len(known)) / 7)
        asked.clear()
        got = lm._encoded(lex, pa.concat_arrays([pa.array(["cut off"]), pa.array(lines)])[1:])
        assert sorted(asked) == words
        for ws, r in zip(plain, got.to_pylist()):
            codes = [int(c) for c in lm.Lexicon.codes(lex, ws)]
            assert r["classes"] == bytes(c & 255 for c in codes) and r["n_tokens"] == len(ws)
            assert r["rare"] == [w.decode() for w, c in zip(ws, codes) if c < 256] and r["n_known"] == sum(c >= 256 for c in codes)
            assert abs(r["words"] - sum(lex.logs[c >> 8] for c in codes)) < 1e-9


def test_attention_gradient_is_that_of_plain_softmax():
    """The gradient equals one taken window by window in float64, at 128 classes, padding and frequent classes among them."""
    r = np.random.default_rng(8)
    start = attention.fresh(128, np.ones((128, 128)))
    m = {n: x.astype(np.float64) for n, x in start.items()}
    ids = np.where(r.random(900) < 0.3, 7, r.integers(0, 128, 900)).astype(np.uint8)
    win, goal = attention.windows(ids, np.array([0, 3, 700, 701, 900]), 0)
    loss, want = 0.0, {n: np.zeros_like(x) for n, x in m.items()}
    n = (goal >= 0).sum()
    for w, g in zip(win, goal):
        for i in range(attention.BLOCK):
            if g[i] < 0:
                continue
            seen, c = w[: attention.BLOCK + i + 1], w[attention.BLOCK + i]
            q, k, v = m["q"][c] + m["pq"][i], m["k"][seen] + m["pk"][: len(seen)], m["v"][seen]
            a = np.exp(k @ q) / np.exp(k @ q).sum()
            p = np.exp(m["b"][c] + (a @ v) @ m["w"])
            p /= p.sum()
            loss -= np.log(p[g[i]]) / n
            d = (p - (np.arange(128) == g[i])) / n
            dh = m["w"] @ d
            ds = a * (v @ dh - a @ v @ dh)
            want["b"][c] += d
            want["w"] += np.outer(a @ v, d)
            want["q"][c] += ds @ k
            want["pq"][i] += ds @ k
            want["pk"][: len(seen)] += np.outer(ds, q)
            np.add.at(want["k"], seen, np.outer(ds, q))
            np.add.at(want["v"], seen, np.outer(a, dh))
    for kind, least in ((np.float64, 1e-12), (np.float32, 1e-6)):
        got_loss, got = attention.gradient({n: x.astype(kind) for n, x in start.items()}, win, goal)
        assert abs(got_loss - loss) < 1e-5 and all(got[n].dtype == kind and np.allclose(got[n], want[n], atol=least) for n in attention.NAMES)


def test_attention_sums_by_rank():
    """Each class's rows are added by rank: as many additions as the most frequent class has rows."""
    r = np.random.default_rng(2)
    for at in (r.integers(0, 128, 768), np.zeros(768, np.int64), np.arange(128), np.array([5])):
        at = at.astype(np.uint8)
        rows = r.standard_normal((len(at), 3))
        want = np.zeros((128, 3))
        np.add.at(want, at, rows)
        order, met, sizes = attention._ranks(at, 128)
        assert sorted(order) == list(range(len(at))) and len(sizes) == np.bincount(at).max() and sizes == sorted(sizes, reverse=True)
        assert np.allclose(attention._ranked_sums(met, sizes, rows[order], 128), want) and np.allclose(attention._sums(at, rows, 128), want)


def test_lm_leading_subwords_of_many_words_at_once(monkeypatch):
    """Looked up together, words get the subword that each gets alone; a slice's rare words take no call each."""
    pieces = lm.Pieces(queries.vocabulary())
    r = np.random.default_rng(6)
    tokens = [*pieces.inner, *pieces.last]
    words = [lm.END, b"x" * 500, "naïve日本".encode(), *tokens[::7], *(a + b for a, b in zip(tokens[::5], tokens[3::5])), *(t + b"\0" for t in tokens[::11]), *(t[:-1] for t in tokens[::13] if len(t) > 1)]
    words += [bytes(r.choice(np.frombuffer(b"\0ae\xc3\xa9", np.uint8), n)) for n in r.integers(1, 13, 3000)]
    words += [bytes(r.integers(0, 256, n).astype(np.uint8)) for n in r.integers(1, 13, 3000)]
    assert pieces.firsts(words).tolist() == [pieces.first(w) for w in words] and len(pieces.firsts([])) == 0
    asked: list[bytes] = []
    plain = lm.Pieces.first
    monkeypatch.setattr(lm.Pieces, "first", lambda self, w: (asked.append(w), plain(self, w))[1])
    rare = ["".join(x) for x in r.choice(["tre", "ion", "qua", "ser", "ing"], (2000, 4))]
    lex = lm.Lexicon(queries.vocabulary(), np.arange(lm.IDS) % 128, [], b"", np.empty(0))
    assert lm._encoded(lex, pa.array([" ".join(rare)])).to_pylist()[0]["n_tokens"] == 2001
    assert len(asked) < 0.2 * len(set(rare))
