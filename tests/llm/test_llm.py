"""Operators against brute force, libraries and exact round trips, on small tables with odd rows."""

from __future__ import annotations

import collections
import hashlib
import html
import io
import random
import re
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import bpe_codec, html_extract, jaccard_join, language_id, media, packing, pii, suffix_dedup, token_counts, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string"


def odd_texts() -> list:
    """Null, empty, blank, very long, repeated, and near copies."""
    rng = random.Random(3)
    words = ["a", "bb", "ccc", "the", "éa", "of", "tion", "xyz", "q1", "Ж😀"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 120))) for _ in range(12)]
    texts = list(base)
    for _ in range(25):
        t, u = rng.choice(base), rng.choice(base)
        i = rng.randint(0, len(t))
        texts.append(u[: rng.randint(0, len(u))] + t[i : rng.randint(i, len(t))] + rng.choice(["", "Z", "x y"]))
    return [*texts, None, "", " \n", "a" * 70_000, "ab" * 300, base[0], base[0]]


@pytest.fixture(scope="module")
def docs(spark):
    texts = odd_texts()
    ids = [*range(len(texts) - 2), 0, None]
    # The column `kept` clashes with a name that operators use.
    rows = [(i, t, "en" if k % 2 else None, f"src{k % 3}" if k % 5 else None, None, "x") for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, DOCS).cache()


@pytest.fixture(scope="module")
def pairs(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def same(got, expected):
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, expected), key=str)


def brute_repeats(texts, t):
    data = [x.encode() for x in texts]
    seen = collections.Counter(d[i : i + t] for d in data for i in range(len(d) - t + 1))
    for d in data:
        cover = np.zeros(len(d) + 1, dtype=int)
        for i in range(len(d) - t + 1):
            if seen[d[i : i + t]] > 1:
                cover[i] += 1
                cover[i + t] -= 1
        gone = np.cumsum(cover)[: len(d)] > 0
        kept = bytes(np.frombuffer(d, dtype=np.uint8)[~gone]) if d else b""
        yield len(d), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()) if d else 0, hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("t,gram,step", [(40, 8, 4), (64, 32, 8), (200, 32, 16)])
def test_suffix_dedup(docs, pairs, t, gram, step):
    got = suffix_dedup.remove_repeats(docs, t, gram, step).drop("kept").collect()
    same(got, [(i, *x) for (i, _), x in zip(pairs, brute_repeats([x for _, x in pairs], t))])


def test_suffix_dedup_repeated_row(spark):
    """All of a repeated row goes, also when it opens with a passage that another text has in its middle."""
    rng = random.Random(11)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    rows = []
    for i in range(0, 80, 2):
        opening = noise(260 + i)
        rows += [(i, opening + noise(400))] * 2 + [(i + 1, noise(300 + i) + opening + noise(300))]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    same(got.drop("kept").collect(), [(i, *x) for (i, _), x in zip(rows, brute_repeats([x for _, x in rows], 200))])


def test_suffix_dedup_long_segments():
    """Segments of a long text overlap, so no window is lost between them."""
    rng = np.random.default_rng(1)
    data = bytes(rng.integers(97, 123, 3 * suffix_dedup.CHUNK // 2, dtype=np.uint8))
    _, _, _, lo, hi, a = suffix_dedup.anchor_blocks([data], 200, 32)
    covered = np.zeros(len(data) - 199, dtype=int)
    for x, y in zip(lo, hi):
        covered[x : y + 1] += 1
    assert (covered == 1).all() and (a >= lo).all() and (a - hi >= 0).all()


def brute_components(pairs, size, num, den):
    sets = []
    for _, t in pairs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and den * both >= num * (len(a) + len(sets[j]) - both):
                up[find(i)] = find(j)
    least: dict = {}
    for i, (d, _) in enumerate(pairs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(pairs, sets))]


def near_copies():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 3, 20, 60, 100, 400]))] for _ in range(20)]
    for _ in range(250):
        w = list(rng.choice(base)) if rng.random() < 0.6 else list(base[8] or ["a"])
        for _ in range(rng.randint(0, 4)):
            if w:
                w[rng.randrange(len(w))] = rng.choice(vocabulary).upper() if rng.random() < 0.3 else rng.choice(vocabulary)
        yield " \t".join(w)


def boilerplate():
    """Texts that are mostly one boilerplate, just under the threshold, and some that link by what else they share."""
    rng = random.Random(6)
    common = [[f"b{k}x{i}" for i in range(120)] for k in range(2)]
    for i in range(160):
        words = common[i % 2][: rng.choice([100, 110, 120])]
        own = [f"u{i if rng.random() < 0.7 else i // 6}y{j}" for j in range(rng.choice([2, 4, 6, 8, 12]))]
        yield " ".join(own + words) if rng.random() < 0.5 else " ".join(words + own)


@pytest.mark.parametrize("tile,block,num", [(8, 16, 90), (128, 512, 80)])
def test_jaccard_join(spark, monkeypatch, tile, block, num):
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = list(enumerate([*near_copies(), *boilerplate(), "", " ", "x"]))
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), num=num)
    same(got.select("doc_id", "n_shingles", "component_id").collect(), brute_components(rows, 3, num, 100))


def test_shared_set_names():
    """Sets that share their first name stay apart by the second one."""
    sets = [np.arange(20, dtype=np.int64), np.arange(30, dtype=np.int64)]
    first = [jaccard_join.set_names(s) for s in sets]
    again = frozenset(u for u, _ in first)
    assert len({jaccard_join.set_names(s, again)[0] for s in sets} | again) == 4


def test_jaccard_odd_rows(docs, pairs):
    got = jaccard_join.jaccard_components(docs).select("doc_id", "n_shingles", "component_id").collect()
    same(got, brute_components(pairs, 3, 90, 100))
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == kept.select("doc_id", "text").distinct().count() < docs.count()


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(text):
    def valid(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            return 12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d[::-1])) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    spans = sorted((m.start(), i, m.end(), k) for i, k in enumerate(PATTERNS) for m in re.finditer(PATTERNS[k], text) if valid(k, m[0]))
    listed = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
    return (*(sum(s[3] == k for s in spans) for k in PATTERNS), hashlib.sha256(listed.encode()).hexdigest(), listed)


def test_pii(spark):
    rng = random.Random(1)
    letters = "ab@@..%+-0123456789 4111é😀(\n"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(800)]
    texts += [None, "", "4111 1111 1111 1111", "x@y.z%a@b.c", "+1 (555) 123-4567-", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4", "9" * 5000, "1 " * 9000, "a" * 90_000, "a@b.co"]
    rows = [*enumerate(texts), (0, texts[0]), (None, "a@b.c")]
    got = pii.digest(pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"))).drop("n_term").collect()
    same(got, [(i, *brute_pii(t or "")) for i, t in rows])


def test_disclosing_terms(spark):
    """A rare word that always comes with an address gives it away; common words do not."""
    rows = [(i, f"Common words number{i} here Zyzzyva met zed@example.com today") for i in range(6)] + [(100 + i, f"Common words number{i} here and there today") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.digest(pii.find_pii(df)).filter("doc_id < 6").collect()
    assert all("term:" in r["spans"] and r["n_email"] == 1 for r in found)
    texts = [r["text"] for r in pii.sanitise(df).filter("doc_id < 6").collect()]
    assert all("Zyzzyva" not in t and "[EMAIL]" in t and "Common words" in t for t in texts)
    clean = pii.sanitise(df).filter("doc_id >= 100").collect()
    assert {(r["doc_id"], r["text"]) for r in clean} == set(rows[6:])


def test_terms_of_rare_values(spark):
    """Values of one or two texts are scored too; words that other texts use stay."""
    rows = [(i, f"plain common words of text{i} that all of them share") for i in range(4000)]
    rows += [(9000, "common words Quixoticus share it one@example.com"), (9001, "plain Brobdingnag words a two@example.com"), (9002, "common Brobdingnag share b two@example.com")]
    rows += [(9003, None), (9004, "nobody@example.com")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert texts[9000] == "common words [NAME] share it [EMAIL]"
    assert texts[9001] == "plain [NAME] words a [EMAIL]" and texts[9002] == "common [NAME] share b [EMAIL]"
    assert all(texts[i] == t for i, t in rows[:4000])


def test_value_of_every_document(spark):
    """Such a value has no information, so nothing discloses it."""
    got = pii.sanitise(spark.createDataFrame([(1, "Zyzzyva met a@example.com")], "doc_id long, text string")).collect()
    assert [r["text"] for r in got] == ["Zyzzyva met [EMAIL]"]


def test_packing(docs, pairs):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    pieces = packing.pack_documents(docs, max_segments=16).collect()
    expected = sorted([(i, t.encode(x, add_special_tokens=False).ids + [1]) for i, x in pairs], key=str)
    used: dict = collections.defaultdict(list)
    for p in pieces:
        used[p["sequence_id"]].append(p)
    for parts in used.values():
        parts.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in parts] == list(np.cumsum([0, *(p["length"] for p in parts)])[:-1])
        n = sum(p["length"] for p in parts)
        assert n <= 2048 and len(parts) <= 16
    want = collections.Counter()
    for i, ids in expected:
        want[i, len(ids)] += len(ids)
    have = collections.Counter()
    for p in pieces:
        have[p["doc_id"], p["doc_tokens"]] += p["length"]
    assert have == want
    by = collections.defaultdict(list)
    for i, ids in expected:
        by[i, len(ids)].append(np.array(ids, dtype="<u4"))
    for p in pieces:
        assert p["ids_crc32"] in {zlib.crc32(a[p["start"] : p["start"] + p["length"]].tobytes()) for a in by[p["doc_id"], p["doc_tokens"]]}
    padding = sum(2048 - n for n in (sum(p["length"] for p in x) for x in used.values()) if n & (n - 1))
    assert padding < 0.05 * sum(want.values())


def test_packing_limits():
    """No sequence is over any of the three limits, the last ones included, and every id is in one piece."""
    rng = np.random.default_rng(0)
    for _ in range(150):
        tokens = int(rng.choice([16, 64, 2048]))
        limits = (tokens, int(rng.choice([1, 3, 16, 300])), int(rng.choice([1, 5, tokens // 2, tokens])))
        packer = packing.VectorPacker(0, *limits, pool=int(rng.choice([4, 32, 1024])))
        docs = []
        for d in range(int(rng.integers(0, 40))):
            n = int(rng.integers(1, 3 * tokens))
            loss = (rng.random(n) < rng.choice([0, 0.3, 1])).astype(np.int64) if rng.random() < 0.5 else np.repeat([0, 1], [n // 2, n - n // 2])
            docs.append((rng.integers(0, 50_000, n).astype("<u4"), loss))
            packer.add(d, *docs[-1])
        packer.finish()
        used, cover = collections.defaultdict(list), collections.defaultdict(list)
        for d, at, n, crc, total, sequence, offset, loss in packer.take():
            assert n > 0 and loss == docs[d][1][at : at + n].sum() and total == len(docs[d][0]) and crc == zlib.crc32(docs[d][0][at : at + n].tobytes())
            used[sequence].append((offset, n, 1, loss))
            cover[d].append((at, n))
        for parts in used.values():
            parts.sort()
            assert [p[0] for p in parts] == [0, *np.cumsum([p[1] for p in parts])[:-1]]
            assert all(sum(p[k + 1] for p in parts) <= limits[k] for k in range(3))
        for d, (ids, _) in enumerate(docs):
            cover[d].sort()
            assert [a for a, _ in cover[d]] == [0, *np.cumsum([n for _, n in cover[d]])[:-1]] and sum(n for _, n in cover[d]) == len(ids)
    for bad in ((0, 1, 1), (1, 0, 1), (1, 1, 0)):
        with pytest.raises(ValueError):
            packing.VectorPacker(0, *bad)


def test_packing_turns(spark):
    """Instruction data: only answers bear loss, and a sequence has at most max_loss such ids."""
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").unionByName(spark.createDataFrame([(None, 0, "assistant", "a b"), (None, 0, None, None)], "conv_id long, turn int, role string, text string"), allowMissingColumns=True)
    pieces = packing.pack_turns(turns, max_loss=700).toPandas()
    encode = bpe_codec.json_encoder()
    want: dict = collections.Counter()
    for r in turns.collect():
        n = len(encode(r["text"] or "")) + 1
        want["ids"] += n
        want["loss"] += n if r["role"] == "assistant" else 0
    assert pieces["length"].sum() == want["ids"] and pieces["loss_tokens"].sum() == want["loss"] > 0
    sums = pieces.groupby("sequence_id").agg(n=("length", "sum"), loss=("loss_tokens", "sum"), parts=("length", "size"))
    assert sums["n"].max() <= 2048 and sums["loss"].max() <= 700 and sums["parts"].max() <= 64
    assert packing.pack_turns(turns.limit(0)).count() == 0


def test_bpe_codec(docs, pairs):
    e = bpe_codec.rank_encoding()
    expected = []
    for i, x in pairs:
        ids = e.encode_ordinary(x)
        expected.append((i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(x.encode()).hexdigest()))
    same(bpe_codec.round_trip(docs).collect(), expected)
    decoded = bpe_codec.decode_documents(bpe_codec.encode_documents(docs)).collect()
    same([(r["doc_id"], bytes(r["bytes"])) for r in decoded], [(i, x.encode()) for i, x in pairs])


def test_safe_splits():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("ab1 \n\t'é.  ") for _ in range(rng.randint(0, 90)))
        parts = bpe_codec.split_safely(text, 7)
        assert "".join(parts) == text
        e = bpe_codec.rank_encoding()
        assert [i for p in parts for i in e.encode_ordinary(p)] == e.encode_ordinary(text)


def test_token_counts(docs, pairs):
    tails, byte_score = token_counts.unigram_model()
    pieces = {k: v for k, v in tails.items() if v is not None}

    def brute(word):
        word = token_counts.MARK + word
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            n = len(word[end - 1].encode())
            options = [(best[end - 1][0] + n * byte_score, -(-best[end - 1][1] + n))]
            options += [(best[b][0] + pieces[word[b:end]], best[b][1] - 1) for b in range(max(0, end - 40), end) if word[b:end] in pieces]
            best.append(max(options))
        return -best[-1][1]

    known: dict = {}
    for w in {w for _, x in pairs for w in x.split() if len(w) < 2000}:
        known[w] = brute(w)
    got = token_counts.count_tokens(docs.filter("length(text) < 2000 or text is null")).collect()
    same(got, [(i, len(x.split()), sum(known[w] for w in x.split())) for i, x in pairs if len(x) < 2000])
    small = token_counts.PrefixTrie(max_nodes=50)
    assert [small.count(w) for w in known] == list(known.values())


def test_long_words(spark):
    """Words that no trie should hold have the counts that the trie would give."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdetionsheé😀ß12") for _ in range(rng.randint(1, 80))) for _ in range(500)]
    trie = token_counts.PrefixTrie()
    assert [trie._alone(token_counts.MARK + w) for w in words] == [trie.count(w) for w in words]
    df = spark.createDataFrame([(1, "ab" * 100_000 + " x"), (2, "x")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df).collect()}
    assert got[1] == trie._alone(token_counts.MARK + "ab" * 100_000) + got[2]


def test_top_k(spark):
    rng = np.random.default_rng(0)
    v = (rng.integers(-3, 4, (300, 3)) / 1024).tolist()
    rows = [*enumerate(v), (7, v[7]), (1000, None), (1001, [None, 1.0, 2.0]), (1002, [float("nan"), 1.0, 2.0]), (1003, [float("inf"), 0.0, 0.0]), (None, [0.1, 0.2, 0.3]), (1100, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ints = {i: np.floor(1024 * np.array(x)).astype(np.int64) for i, x in rows if i is not None and x and None not in x and np.isfinite(x).all()}
    expected = []
    for q in (i for i in ints if i % 100 == 0):
        best = sorted((-int(ints[q] @ x), i) for i, x in ints.items() if i != q)[:10]
        expected += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    for block in (None, 40):
        same(topk.top_k(df, F.col("vec_id") % 100 == 0, block_rows=block).collect(), expected)


def test_top_k_large_components(spark):
    """Scores are exact beyond 2^53; one that no long holds is an error."""
    df = spark.createDataFrame([(0, [1e6, 3.0]), (1, [1e6, 5.0]), (2, [-1e6, 7.0])], "vec_id long, embedding array<double>")
    one = int(1e6 * 1024)
    same([(r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") == 0).collect()], [(1, one * one + 3072 * 5120), (2, 3072 * 7168 - one * one)])
    for big in (1e8, 1e17):
        with pytest.raises(Exception, match="no long"):
            topk.top_k(spark.createDataFrame([(0, [big]), (1, [big])], "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()


def test_media(spark, docs, pairs, tmp_path):
    got = {(r["doc_id"], r["payload_sha256"]): r for r in media.media_features(docs).collect()}
    assert len(got) == len({(i, x) for i, x in pairs})
    for i, x in pairs:
        payload, n = media.payload_of(x)
        r = got[i, hashlib.sha256(payload).hexdigest()]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (n, len(payload), zlib.crc32(payload[-32:]))
        assert len(payload) % 576 == 0 and r["media_sha256"] == hashlib.sha256(media.to_png(payload)).hexdigest()
    path = f"file://{tmp_path}/archives"
    media.write_archives(docs, path)
    ranged = media.read_archives(spark, path, range_bytes=500)
    assert ranged.count() == len(pairs) and ranged.rdd.getNumPartitions() > 4
    damaged = bytearray(media.to_png(b"x" * 576))
    damaged[50] ^= 1
    with pytest.raises(ValueError):
        media.from_png(bytes(damaged))


def test_member_is_read_again(tmp_path):
    """A member that fails is read again on its own, through a new handle."""
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("0_1.png", b"data")
    with zipfile.ZipFile(tmp_path / "a.zip") as z:
        member = z.infolist()[0]
    reader = media.ArchiveReader({"path": "", "retries": 2})

    class Store:
        """Each handle is lost at its first read until `left` of them are gone."""

        def __init__(self, left):
            self.left, self.opened = left, 0

        def open_input_file(self, name):
            self.opened += 1
            self.left -= 1
            lost = self.left >= 0

            class Handle(io.FileIO):
                def read_at(self, n, at):
                    if lost:
                        raise OSError("lost")
                    self.seek(at)
                    return self.read(n)

            return Handle(name)

    store = Store(2)
    assert reader._member(media.Archive(store, str(tmp_path / "a.zip")), member) == b"data" and store.opened == 3
    with pytest.raises(OSError):
        reader._member(media.Archive(Store(5), str(tmp_path / "a.zip")), member)
    member.CRC ^= 1
    with pytest.raises(ValueError, match="damaged"):
        reader._member(media.Archive(Store(0), str(tmp_path / "a.zip")), member)


def test_html_extract(spark):
    page = (
        "<html><head><title>T</title><style>p{{}}</style><script>var a='<p>x</p>'</script></head><body><nav><a href='/a'>menu {0}</a></nav><!-- <p>no</p> -->"
        "<div class='cookie-notice'>We use cookies</div><div class='ad'>buy {0}</div><article><h1>Head &amp; {0}</h1><p>one  <b>two</b>\n three<br>four<p>five &eacute;&copy<aside>side</aside>"
        "<form><input>name</form><ul><li>six<li>seven</ul></article><section class='comments'><p>nice</p></section><footer>f</footer></body></html>"
    )
    plain = "<body><div class='top'>Site name</div><div class='text'><p>story {0} is long enough to be the story</p><p>and goes on {0}</p></div><div class='end'>All rights</div></body>"
    rows = [(i, f"http://a.example.com/{i}", page.format(i)) for i in range(6)] + [(10 + i, f"https://b.example.com/{i}", plain.format(i)) for i in range(8)]
    rows += [(20, None, None), (21, "odd", ""), (22, "http://c.example.org", "<p>cut <b"), (22, "http://c.example.org", "<p>cut <b")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    texts = collections.defaultdict(list)
    for r in got:
        texts[r["page_id"]].append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert texts[3] == ["Head & 3\none two three four\nfive é©\nsix\nseven"]
    assert texts[12] == ["story 2 is long enough to be the story\nand goes on 2"]
    assert texts[20] == [""] and texts[21] == [""] and texts[22] == ["cut", "cut"] and len(got) == len(rows)


def test_html_pages(spark):
    """On the test pages the article element says what the text is."""
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {}
    for r in rows.collect():
        a = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", a)]
        want[r["page_id"]] = "\n".join(b for b in blocks if b)
    assert {r["page_id"]: r["text"] for r in html_extract.extract(rows).collect()} == want


def test_html_template_decides(spark):
    """Repeated notices inside an article go; a story in a div is not lost to article teasers."""
    story = "a story of page {0} that is told at some length and not on any other page, with number {0}"
    notice = f"<body><article><p>Read our terms of use.</p><h1>Head {{0}}</h1><p>{story}</p><p>All rights are reserved.</p></article></body>"
    teasers = f"<body><div class='story'><h1>Head {{0}}</h1><p>{story}</p></div><article><p>teaser {{0}}</p></article><article><p>another {{0}}</p></article></body>"
    rows = [(10 * k + i, f"http://{k}.example.com/{i}", page.format(i)) for k, page in enumerate([notice, teasers]) for i in range(7)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {10 * k + i: f"Head {i}\n{story.format(i)}" for k in range(2) for i in range(7)}


def test_html_without_names(spark):
    """The template alone finds the article: no article element, no list of names. Without it nothing is right."""
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {r["page_id"]: r["text"] for r in html_extract.extract(rows).collect()}
    div = rows.withColumn("html", F.regexp_replace("html", "(</?)article", "$1div"))
    assert {r["page_id"]: r["text"] for r in html_extract.extract(div, frozenset()).collect()} == want
    assert all(html_extract.article_text(r["html"], None, frozenset(), names=frozenset()) != want[r["page_id"]] for r in div.collect())


def test_html_brute_deduction(spark):
    """Classes from explicit occurrence vectors, on random hosts; batches and order change nothing."""
    rng = random.Random(9)
    rows, n = [], 0
    for h in range(20):
        parts = [f"<div class='{rng.choice('abc')}'><p>{'template text of host ' * rng.randint(1, 3)}{h}</p></div>" for _ in range(rng.randint(0, 3))]
        for i in range(rng.randint(1, 8)):
            story = "".join(f"<p>story {h} {i} {rng.random()}</p>" for _ in range(rng.randint(0, 3)))
            body = [x for x in parts if rng.random() < 0.9] + [f"<div class='m'>{story}</div>"] + ["<section class='n'><p>note</p></section>"] * rng.randint(0, 2)
            rng.shuffle(body)
            rows += [(n, f"http://h{h}.example.com/", f"<body>{''.join(body)}</body>")] * rng.choice([1, 1, 1, 2])
            n += 1
    tokens: dict = collections.defaultdict(lambda: collections.defaultdict(list))
    urls = collections.Counter(u for _, u, _ in rows)
    for at, (_, url, page) in enumerate(rows):
        blocks, seen = html_extract.content(page)
        counts = collections.Counter({("e", p): c for p, c in seen.items()}) + collections.Counter(("t", x[0], x[1]) for x in blocks)
        for k, c in counts.items():
            chars = sum(len(x[1]) for x in blocks if html_extract.inside(x[0], k[1])) if k[0] == "e" else c * len(k[2])
            tokens[url if urls[url] > 1 else ""][k].append((at, c, chars))
    want = {}
    for host, found in tokens.items():
        vectors: dict = collections.defaultdict(list)
        for k, v in found.items():
            vectors[tuple((at, c) for at, c, _ in v)].append(k)
        valid = [k for v, ks in vectors.items() if len(ks) >= 2 and len(v) >= 2 for k in ks]
        if not valid:
            continue
        pages = max(len(v) for v in found.values())
        elements = [(k[1], all(c == 1 for _, c, _ in found[k]) and k[1].split("/")[-1].split(".")[0] in html_extract.SECTION, sum(x for *_, x in found[k])) for k in valid if k[0] == "e" and 2 * len(found[k]) > pages]
        texts = [(html_extract._name(*k), k[1], sum(x for *_, x in found[k])) for k in valid if k[0] == "t" and len(found[k]) >= max(5, 0.6 * pages)]
        if elements or texts:
            slot, names = html_extract.choose_slot(elements, texts)
            want[host.removeprefix("http://").strip("/")] = (slot, sorted(names))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    host = F.regexp_extract("url", "//([^/]*)", 1)
    several = [u.removeprefix("http://").strip("/") for u, c in urls.items() if c > 1]
    hosted = df.select("page_id", "html", F.when(host.isin(several), host).otherwise("").alias("host"))
    texts = sorted(map(tuple, html_extract.extract(df).collect()))
    for parts in (1, 7):
        got = {r["host"]: (r["slot"], sorted(r["texts"])) for r in html_extract.deduce_templates(hosted.repartition(parts, "page_id", "html")).collect()}
        assert got == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        assert sorted(map(tuple, html_extract.extract(df.repartition(3)).collect())) == texts
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_html_copies_stay(spark):
    """Equal pages keep their text, as nothing tells template from story."""
    rows = [(i, "http://a.example.com/", "<body><article><h1>Head</h1><p>story</p></article></body>") for i in range(6)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r["text"] for r in got] == ["Head\nstory"] * 6


def test_language_id(spark):
    """Held-out accuracy, and evidence where the text has none."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.identify(df, sample=60).toPandas()
    assert (found["declared"] == found["language"]).mean() > 0.99 and found["accepted"].mean() > 0.98
    rows = [(i, t, lang, host) for i, (t, lang, host) in enumerate([("the cat of the house", "en", "http://a.co.uk/x")] * 30 + [("le chat de la maison", "fr", "http://b.fr/y")] * 30 + [(None, "en", "x.fr"), ("", None, None), ("12", None, "http://b.fr/z"), ("qq", "xx", "b.fr")])]
    got = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[0]["language"] == "en" and got[40]["language"] == "fr"
    assert got[60]["language"] == "und" and not got[60]["accepted"] and not got[61]["accepted"]
    assert got[62]["language"] == "fr"


def brute_language(rows, full_text=400, temper=3.0):
    """(text language, language, confidence) of each row by plain counting. rows: text, declared, host."""
    languages = sorted({d.lower() for t, d, _ in rows if d is not None and t is not None})
    n = len(languages)
    table = np.full((language_id.FEATURES, n), 0.1)
    for t, d, _ in rows:
        if t is not None and d is not None:
            np.add.at(table[:, languages.index(d)], language_id.features(t), 1)
    table = np.log(table / table.sum(axis=0)).astype(np.float32)
    feats = [language_id.features(t) for t, *_ in rows]
    means = [table[f].mean(axis=0, dtype=np.float64) if len(f) else np.zeros(n) for f in feats]
    best = [int(np.argmax(m)) if len(f) else None for m, f in zip(means, feats)]
    prior, said = np.ones(n), np.full((n, n), 0.5) + np.eye(n)
    by: dict = collections.defaultdict(lambda: np.zeros(n))
    part = lambda host: ((host or ""), ".".join((host or "").split(".")[-2:]) if "." in (host or "") else "", (host or "").rpartition(".")[2] if "." in (host or "") else "")
    for (t, d, host), b in zip(rows, best):
        if b is not None:
            prior[b] += 1
            if d is not None:
                said[languages.index(d), b] += 1
            for kind, x in zip("hps", part(host)):
                by[kind, x][b] += 1
    prior /= prior.sum()
    said = np.log(said / said.sum(axis=0))
    smooth = lambda c, p: (c + language_id.KAPPA * p) / (c.sum() + language_id.KAPPA)
    for (t, d, host), m, f, b in zip(rows, means, feats, best):
        h, p, s = part(host)
        logs = np.log(prior)
        if ("h", h) in by:
            up = smooth(by["p", p], prior) if p else prior
            logs = np.log(smooth(by["h", h], up) if h else prior) + (np.log(smooth(by["s", s], prior)) - np.log(prior) if s else 0)
        if d is not None:
            logs = logs + said[languages.index(d)]
        logs = logs + m * min(len(f), full_text) / temper
        sure = 1 / np.exp(logs - logs.max()).sum()
        yield (languages[b], languages[int(np.argmax(logs))] if sure >= 0.5 else "und", sure) if b is not None else ("und", "und", 0.0)


def test_language_brute_force(spark):
    """Fused evidence against plain counting; hosts, suffixes and markup turn short texts the right way."""
    rng = random.Random(4)
    source = [r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if r["text"] and r["lang"]][:400]
    rows = []
    for i, r in enumerate(source):
        host = rng.choice([f"www.{r['lang']}{i % 3}.{r['lang']}", f"{r['lang']}.mixed.org", "www.mixed.org", None])
        words = r["text"].split()
        text = r["text"] if i % 4 == 0 else rng.choice(words)[-2:]
        rows.append((text, r["lang"] if rng.random() < 0.5 else None, host, r["lang"]))
    rows += [(None, "en", "a.b.fr", "en"), ("", None, None, "en"), *rows[:3]]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "doc_id long, text string, lang string, source string, truth string")
    got = {r["doc_id"]: r for r in language_id.identify(df, sample=1000).collect()}
    right = collections.Counter()
    for i, (want, (*_, truth)) in enumerate(zip(brute_language([x[:3] for x in rows]), rows)):
        assert (got[i]["text_language"], got[i]["language"]) == want[:2] and abs(got[i]["confidence"] - want[2]) < 2e-6
        right["text"] += want[0] == truth
        right["fused"] += want[1] == truth
    assert right["fused"] > right["text"] + 20  # of 405
    with pytest.raises(ValueError, match="declared"):
        language_id.identify(df, max_languages=2)


CLASHES = ["id", "h", "_id", "_h", "row", "spans", "_spans", "disclosed", "_disclosed", "label", "kept", "block", "base", "u", "n"]


def test_clashing_columns(spark, docs):
    """Columns of any name come back with their values."""
    import corpus_pipeline

    rows = docs.drop("kept").withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASHES})
    want = {(r["doc_id"], *(r[c] for c in CLASHES)) for r in rows.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, rows, "")
        assert got.columns == rows.columns
        assert {(r["doc_id"], *(r[c] for c in CLASHES)) for r in got.collect()} <= want, name
    plain = docs.select("doc_id", "text", "lang", "source")
    for f in (suffix_dedup.remove_repeats, language_id.identify, packing.pack_documents, bpe_codec.round_trip, token_counts.count_tokens):
        same(f(rows).collect(), f(plain).collect())


def test_empty_tables(spark, docs):
    none = docs.filter(F.lit(False))
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert jaccard_join.jaccard_components(none).count() == 0
    assert pii.find_pii(none).count() == 0
    assert language_id.identify(none).count() == 0
    assert packing.pack_documents(none).count() == 0
    assert media.media_features(none).count() == 0
    assert bpe_codec.round_trip(none).count() == 0
    assert token_counts.count_tokens(none).count() == 0
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.lit(True)).count() == 0
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    docs.drop("kept").write.parquet(f"file://{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        nxt = stage(spark, now, f"file://{tmp_path}")
        if name != "packing":
            assert nxt.columns == now.columns and 0 < nxt.count() <= now.count()
        now = nxt
    docs.drop("kept").filter(F.lit(False)).write.parquet(f"file://{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/none").count() == 0
    run = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert run.select("doc_id", "length").groupBy().sum("length").first() == now.groupBy().sum("length").first()


def test_language_tables_count_all_rows(spark):
    """A word of one language that only rows beyond any sample of 400 use decides for the texts that have only it."""
    last = spark.range(900).selectExpr("id", "'vvvv zzzz qqqq xyxy' as text").orderBy(F.expr("xxhash64(id, xxhash64(text is null, text))").desc()).limit(100)
    new = {r["id"]: r["text"] for r in last.collect()}
    rows = [(i, new.get(i, "alpha beta gamma delta"), "aa", None) for i in range(900)] + [(900 + i, "nisse pulk oster zzyy", "bb", None) for i in range(900)] + [(5000, "zzzz qqqq", None, None)]
    got = {r["doc_id"]: r["text_language"] for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[5000] == "aa"
    counted = language_id._train(spark.createDataFrame([("aa", r[1]) for r in rows[:900]], "declared string, text string").repartition(3), ["aa"])
    table = np.full((language_id.FEATURES, 1), 0.1)
    for r in rows[:900]:
        np.add.at(table[:, 0], language_id.features(r[1]), 1)
    assert np.allclose(counted, np.log(table / table.sum()), atol=1e-6)
