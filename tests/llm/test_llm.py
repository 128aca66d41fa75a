"""Each operator of readloom.llm against brute force or an exact round trip, and on odd inputs."""

import hashlib
import random
import re
import struct
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from readloom.llm import bitsliced, chat, language, media, mixing, near_dup, packing, passages, quality, token_files
from readloom.llm.components import connected_components
from readloom.llm.scratch import Scratch
from readloom.llm.tokens import ChunkTokenizer

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, " ", "\n\t ", "a", "a b", "é à  ß", "日本語 テスト", "x" * 3000, "  lead and trail  ", "<s>[INST] & &amp; &lt;", "same text here now", "same text here now"]


def documents(spark, texts, first=0):
    rows = [(first + i, t, "en" if i % 2 else None, "src0", len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """Extra columns with names that operators use themselves."""
    return df.withColumns({n: F.concat(F.lit(n), F.lit(i)) if i % 2 else F.lit(i) for i, n in enumerate(CLASHES)})


CLASHES = (
    "row", "h", "node", "value", "_hit", "_doc", "_h", "word", "place", "score", "copies", "_copy", "label", "n", "doc", "hit", "stays", "_stays", "_n", "given", "of", "key",
    "_key", "bitmap_word", "bitmap_bit", "bitmap_bits", "_word", "_bit", "kept_text", "spans", "predicted", "lang_pred", "rate", "domain", "draw", "first", "number", "state",
)


def same_extras(rows, but=()):
    """Whether rows still have what ``clashing`` gave them."""
    return all(r[n] == (f"{n}{i}" if i % 2 else i) for r in rows for i, n in enumerate(CLASHES) if n not in but)


def vocabulary(rng, n=400):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n)]


# --- 1 -----------------------------------------------------------------------


def test_top_k_is_exact_with_ties(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.25, 0.5, -0.3]) for _ in range(5)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(40)]  # many equal vectors
    rows += [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0]), (902, [float("nan")] + [0.0] * 4), (903, [float("inf")] + [0.0] * 4), (904, []), (905, [1.0, 2.0]), (None, [1.0] * 5)]
    table = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = bitsliced.top_k(table, table.where("vec_id % 10 = 0"), 5).collect()
    known = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v in rows[:340]}
    expected = set()
    for q in (i for i in known if i % 10 == 0):
        best = sorted((-sum(a * b for a, b in zip(known[q], v)), i) for i, v in known.items() if i != q)[:5]
        expected |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)
    assert bitsliced.top_k(table.where("false"), table.where("false")).count() == 0


def test_top_k_of_wide_values_and_repeated_rows(spark):
    rows = [(0, [1.0, 1.0]), (1, [300000.0, 1.0]), (2, [-3.0e6, 7.5]), (3, [2.0**40, -(2.0**40)]), (50, [1.0, None]), (50, [2.0, -1.0]), (100, [0.5, 0.5]), (100, [0.5, 0.5]), (100, [-1.0, 0.25])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = Counter(tuple(r) for r in bitsliced.top_k(table, table.where("vec_id % 50 = 0"), 3).collect())
    known = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if None not in v]
    wanted = Counter()
    for q, v in known:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in known if i != q)[:3]
            wanted.update((q, r + 1, i, -s) for r, (s, i) in enumerate(best))
    assert got == wanted and any(k[:3] == (0, 1, 1) or k[2] == 1 for k in got)
    huge = spark.createDataFrame([(0, [1e300]), (1, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        bitsliced.top_k(huge, huge).collect()


def test_blocks_add_and_select_like_integers():
    rng = np.random.default_rng(2)
    for _ in range(20):
        values, q = rng.integers(-300, 300, (150, 7)), rng.integers(-300, 300, (3, 7))
        bits, low, slices = bitsliced.slice_block(values)
        qid, vid, score = bitsliced.search_block(np.arange(150), low, slices, np.array([-1, -2, 5]), q, 9)
        for k, name in enumerate((-1, -2, 5)):
            want = sorted((-int(s), i) for i, s in enumerate(values @ q[k]) if i != name)[:9]
            assert sorted(zip((-score[qid == k]).tolist(), vid[qid == k].tolist())) == want


# --- 2 -----------------------------------------------------------------------


def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute_components(texts, width, percent):
    sets = [shingle_set(t, width) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sets, [find(i) for i in range(len(texts))]


def near_copies(seed, base_docs=25):
    rng = random.Random(seed)
    vocab, texts = vocabulary(rng), list(ODD)
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    for _ in range(base_docs):
        words = [rng.choice(vocab) for _ in range(rng.randint(1, 90))]
        texts.append(" ".join(words))
        if rng.random() < 0.4:
            texts.append(" ".join(words) + " " + passage)
        for _ in range(rng.choice([0, 1, 4])):
            w = list(words)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w).capitalize())
    for i in range(25):  # a large group of near copies
        w = (passage + " tail end of it").split()
        w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join(w))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("long_lists", [False, True])
@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, width, percent, long_lists):
    if long_lists:
        monkeypatch.setattr(near_dup, "LIST", 6)
    texts = near_copies(width + 10 * long_lists)
    sets, roots = brute_components(texts, width, percent)
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(clashing(documents(spark, texts)), width, percent).collect()}
    assert len(got) == len(texts)
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i]["component_id"] for i in range(len(texts))] == roots
    assert [got[i]["first"] for i in range(len(texts))] == [roots[i] == i for i in range(len(texts))]


def edited(rng, vocab, words, edits):
    w = list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(w)), rng.random()
        w[at : at + 1] = [rng.choice(vocab)] if kind < 0.6 else [] if kind < 0.8 else [w[at], rng.choice(vocab)]
    return w


def test_links_inside_long_lists(spark):
    """Lists of far more than ``LIST`` members, near copies on both sides of the threshold, hot passages that are combined: all links are found."""
    rng = random.Random(77)
    vocab = vocabulary(rng, 3000)
    body = lambda n: [rng.choice(vocab) for _ in range(n)]
    one, two, line = body(120), body(100), body(12)
    texts = [" ".join(edited(rng, vocab, one, rng.randint(1, 9))) for _ in range(150)]
    families = [edited(rng, vocab, one, 9) for _ in range(25)]  # apart from the others, in pairs alike
    texts += [" ".join(edited(rng, vocab, f, e)) for f in families for e in (0, 2)]
    texts += [" ".join(two + line * rng.randint(0, 2) + body(rng.randint(0, 8))) for _ in range(60)]
    texts += [" ".join(one + two), " ".join(one[:70] + two), " ".join(line), " ".join(line + one[:40]), " ".join(one + line)] * 2
    rng.shuffle(texts)
    for width, percent in ((3, 85), (5, 80)):
        _, roots = brute_components(texts, width, percent)
        assert len(set(roots)) > 40
        got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(documents(spark, texts), width, percent).collect()}
        assert [got[i] for i in range(len(texts))] == roots


def test_one_row_of_each_group_stays(spark):
    texts = near_copies(5, 8)
    docs = documents(spark, texts)
    docs = docs.unionByName(docs.where("doc_id < 20"))  # repeated rows
    docs = docs.unionByName(spark.createDataFrame([(None, "an id is missing here and now", None, None, None)] * 2, DOCS))
    _, roots = brute_components(texts, 5, 80)
    kept = near_dup.without_near_duplicates(clashing(docs)).collect()
    assert same_extras(kept)
    counts = Counter(r["doc_id"] for r in kept)
    blank = {i for i, t in enumerate(texts) if not shingle_set(t, 5)}
    assert {i for i in counts if i is not None} == {i for i, r in enumerate(roots) if i == r}
    assert all(counts[i] == (2 if i in blank and i < 20 else 1) for i in counts)
    assert near_dup.without_near_duplicates(docs.where("false")).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"), "c").collect()
    assert {r["node"]: r["component"] for r in got} == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}}


# --- 3 and 5 -----------------------------------------------------------------


def odd_texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(" a.,!?×a\nbé'9. ́<|ß日 　AX|>") for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("path, keep_space", [(BYTE, True), (WORD, False)])
def test_chunks_give_the_ids_of_whole_texts(path, keep_space):
    from readloom.llm.bytescan import text_buffer

    texts = [t for t in ODD] + odd_texts(3, 1500) + ["<|endoftext|> a<|endoftext|>b, c", "don't we've. He'd! x.y"]
    coder = ChunkTokenizer(path, keep_space)
    ids, at = coder.encode(*text_buffer(pa.array(texts, pa.string())))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == coder.tokenizer.encode(t or "", add_special_tokens=False).ids, t


def plain_ids(path, texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [t.encode(x or "", add_special_tokens=False).ids + [end] for x in texts]


def test_token_files_round_trip(spark, monkeypatch):
    texts = ODD + odd_texts(4, 200) + [" ".join(vocabulary(random.Random(5), 3000))]
    root = Scratch(spark, "test").path("shards")
    shards = token_files.write_tokens(clashing(documents(spark, texts)), root, BYTE, 2)
    ids, at = plain_ids(BYTE, texts, 2), 0
    got = sorted(token_files.read_documents(shards, root).collect(), key=lambda r: r["doc_id"])
    for i, r in enumerate(got):
        assert (r["doc_id"], r["start"], r["n_tokens"], list(r["ids"])) == (i, at, len(ids[i]), ids[i])
        at += len(ids[i])
    digest = {r["doc_id"]: r["ids_crc32"] for r in token_files.read_documents(shards, root, digest_only=True).collect()}
    assert digest == {i: zlib.crc32(struct.pack(f"<{len(x)}I", *x)) for i, x in enumerate(ids)}
    assert token_files.write_tokens(documents(spark, []), root, BYTE, 2).count() == 0


def test_sequences_at_random(tmp_path):
    path, flat = str(tmp_path / "x.arrows"), np.arange(1000) % 65536
    with pa.OSFile(path, "wb") as sink:
        out = token_files.SequenceWriter(sink, np.dtype(np.uint16), 16, 8)
        for part in np.array_split(flat, 13):
            out.add(part)
        out.close()
    file = token_files.SequenceFile(path)
    for i in (62, 0, 17, 8, 61):
        ids, mask = file[i]
        filled = np.unpackbits(mask, bitorder="little").astype(bool)
        assert ids[filled].tolist() == flat[16 * i : 16 * i + 16].tolist()
    with pytest.raises(IndexError):
        file[63]


def brute_bins(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + items[i] <= capacity:
                bins[j] += items[i]
                go(i + 1, bins)
                bins[j] -= items[i]
        bins.append(items[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best[0] if items else 0


def test_plans_are_optimal_on_small_cases():
    rng = random.Random(3)
    for _ in range(150):
        capacity = rng.choice([10, 20, 50])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(0, 10))]
        counts = Counter(items)
        plan, used = packing.plan_bins(counts, capacity), Counter()
        for pattern, times in plan:
            assert sum(pattern) <= capacity and times > 0
            for k in pattern:
                used[k] += times
        assert used == counts
        assert sum(n for _, n in plan) == brute_bins(items, capacity) >= packing.lower_bound(counts, capacity) * bool(items)


def test_first_descent_ends_with_many_lengths():
    rng = random.Random(1)
    counts = Counter([rng.randint(800, 2000) for _ in range(60000)] + [rng.randint(2000, 4096) for _ in range(20000)])
    assert len(counts) > packing.NODES
    assert sum(n for _, n in packing.plan_bins(counts)) < sum(n for _, n in packing.best_fit(counts, 4096))


def test_packing_of_documents(spark):
    texts = ODD + odd_texts(6, 100) + [" ".join(vocabulary(random.Random(7), 900))]
    got = packing.pack(clashing(documents(spark, texts)), WORD, 1, capacity=64).collect()
    ids = plain_ids(WORD, texts, 1)
    expected = {(i, k // 64): (k, len(x[k : k + 64]), zlib.crc32(struct.pack(f"<{len(x[k : k + 64])}I", *x[k : k + 64]))) for i, x in enumerate(ids) for k in range(0, len(x), 64)}
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == expected and len(got) == len(expected)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(documents(spark, []), WORD, 1).count() == 0


# --- 4 -----------------------------------------------------------------------


def test_media_round_trip(spark):
    path = Scratch(spark, "test").path("media")
    media.write_media(clashing(documents(spark, ODD + ["y" * 576, "z" * 5000])), path, archive_bytes="2000")
    got = {r["doc_id"]: r for r in media.describe_media(media.read_media(spark, path, split_bytes="700")).collect()}
    for i, t in enumerate(ODD + ["y" * 576, "z" * 5000]):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert media.decode_png(media.encode_png(payload)) == payload
    assert got[11]["media_sha256"] == got[12]["media_sha256"] and got[11]["feature"] == got[12]["feature"]
    media.write_media(documents(spark, ["more", "more"]), path)  # a second job adds to the first
    assert media.read_media(spark, path).count() == len(ODD) + 4
    media.write_media(documents(spark, ["other"]), path, mode="overwrite")
    assert [r["n_bytes"] for r in media.describe_media(media.read_media(spark, path)).collect()] == [5]
    empty = Scratch(spark, "test").path("none")
    media.write_media(documents(spark, []), empty)
    assert media.read_media(spark, empty).count() == 0


def test_damaged_members_fail_alone(spark, tmp_path):
    media.write_media(documents(spark, ["one", "two", "three"]).coalesce(1), str(tmp_path))
    (archive,) = [p for p in tmp_path.iterdir() if p.suffix == ".zip"]
    with zipfile.ZipFile(archive) as z:
        at = z.infolist()[1].header_offset
    data = bytearray(archive.read_bytes())
    data[at + 80] ^= 255
    archive.write_bytes(data)
    with pytest.raises(Exception, match="damaged"):
        media.read_media(spark, str(tmp_path)).collect()
    rows = media.read_media(spark, str(tmp_path), strict="false").collect()
    assert sorted(r["error"] is None for r in rows) == [False, True, True]


# --- 6 -----------------------------------------------------------------------


def test_planted_passages(spark):
    rng = random.Random(9)
    vocab = vocabulary(rng, 900)
    body = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage = body(80)
    fuzzy = passage[:25] + ["changed"] + passage[26:50] + passage[51:]
    texts = [*ODD, " ".join(body(100)), " ".join(body(30) + passage + body(30))]
    keeper = len(texts) - 1
    texts += [" ".join(body(40) + passage), " ".join(fuzzy + body(50)), " ".join(body(20) + passage[:30] + body(20)), " ".join(body(200))]
    texts.append(texts[keeper])
    texts.append(" ".join(["la le lu"] * 200))  # repeats itself only
    docs = clashing(documents(spark, texts))
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in passages.repeated_passages(docs).collect()}
    assert set(got) == {keeper + 1, keeper + 2, keeper + 5}
    assert got[keeper + 1] == [(40, 120)] and got[keeper + 5] == [(0, 140)]
    assert got[keeper + 2][0][0] == 0 and abs(got[keeper + 2][0][1] - 79) <= 1
    rows = passages.without_passages(docs).collect()
    assert same_extras(rows)
    after = {r["doc_id"]: r for r in rows}
    assert len(after) == len(texts) and after[keeper]["text"] == texts[keeper] and after[keeper + 5]["text"] == ""
    assert after[keeper + 1]["n_chars"] == len(after[keeper + 1]["text"]) and after[1]["text"] is None
    assert passages.repeated_passages(docs.where("false")).count() == 0


def fresh(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(n)]


def spans_of(spark, texts):
    return {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in passages.repeated_passages(documents(spark, [" ".join(t) for t in texts])).collect()}


def test_fuzzy_passages_by_edit_rate(spark):
    rng, texts, wanted = random.Random(21), [], {}
    for rate in (0.0, 0.05, 0.08, 0.1):
        for _ in range(25):
            passage, copy = fresh(rng, 80), []
            for w in passage:
                kind = rng.choice(["other", "more", "none"]) if rng.random() < rate else "same"
                copy += {"other": fresh(rng, 1), "more": [w, *fresh(rng, 1)], "none": [], "same": [w]}[kind]
            texts += [fresh(rng, 60) + passage + fresh(rng, 60), fresh(rng, 50) + copy + fresh(rng, 50)]
            one, two = (np.array([int.from_bytes(w.encode()[:7]) for w in t]) for t in (copy, passage))
            if passages.agreeing(one, two) >= passages.AGREE * len(copy):  # by an alignment of all words
                wanted[len(texts) - 1] = (rate, len(copy))
    got = spans_of(spark, texts)
    assert set(got) <= set(wanted)
    for rate in (0.0, 0.05, 0.08, 0.1):
        cases = [(i, n) for i, (r, n) in wanted.items() if r == rate]
        covered = [sum(max(0, min(b, 50 + n) - max(a, 50)) for a, b in got.get(i, [])) for i, n in cases]
        assert all(c >= 50 for c in covered) and sum(covered) >= 0.95 * sum(n for _, n in cases), rate


def test_passages_go_beyond_the_part_that_the_least_document_has(spark):
    rng, texts = random.Random(22), []
    for part, whole in [(40, 52), (45, 55), (49, 60)] * 12:
        passage = fresh(rng, whole)
        texts += [fresh(rng, 30) + passage[:part] + fresh(rng, 30), fresh(rng, 40) + passage + fresh(rng, 40), fresh(rng, 20) + passage + fresh(rng, 20)]
    assert spans_of(spark, texts) == {3 * i + 2: [(20, 20 + whole)] for i, (_, whole) in enumerate([(40, 52), (45, 55), (49, 60)] * 12)}


def test_templates_with_other_words_in_their_slots_stay(spark):
    rng, texts = random.Random(23), []
    for fixed in [16, 12] * 10:
        lines = [fresh(rng, fixed) for _ in range(12)]
        texts += [[w for line in lines for w in line + fresh(rng, 12)] for _ in range(2)]
    lines = [fresh(rng, n) for n in (60, 16, 16)]  # only the first is long enough by itself
    texts += [[w for line in lines for w in line + fresh(rng, 12)] for _ in range(2)]
    assert spans_of(spark, texts) == {41: [(0, 60)]}


def test_short_pieces_of_several_documents_are_no_passage(spark):
    rng, texts = random.Random(24), []
    pieces = [fresh(rng, 20) for _ in range(6)]
    texts += [fresh(rng, 30) + p + fresh(rng, 30) for p in pieces] + [fresh(rng, 10) + sum(pieces, []) + fresh(rng, 10)]
    assert spans_of(spark, texts) == {}


def test_exact_passages_against_brute_force(spark):
    """Whatever an earlier document has in a row of 50 words or more is found, and what is found agrees with one earlier document."""
    rng, texts = random.Random(25), []
    pool = [fresh(rng, rng.randint(30, 90)) for _ in range(12)]
    for _ in range(40):
        texts.append([w for _ in range(rng.randint(1, 4)) for w in (rng.choice(pool) if rng.random() < 0.5 else fresh(rng, rng.randint(5, 60)))])
    got, number = spans_of(spark, texts), {}
    coded = [np.array([number.setdefault(w, len(number)) for w in t]) for t in texts]
    for i, own in enumerate(coded):
        must = np.zeros(len(own), bool)
        for other in coded[:i]:
            runs = np.zeros(len(other) + 1, np.int64)
            for at, w in enumerate(own):
                runs[1:] = np.where(other == w, runs[:-1] + 1, 0)
                n = int(runs.max())
                if n >= passages.MIN_WORDS:
                    must[at + 1 - n : at + 1] = True
        found = np.zeros(len(own), bool)
        for a, b in got.get(i, []):
            found[a:b] = True
            assert max(passages.agreeing(own[a:b], other) for other in coded[:i]) >= passages.AGREE * min(b - a, passages.MIN_WORDS)
        assert (found | ~must).all(), i


def test_seeds_within_a_context_are_seeds_of_all_texts_that_have_it():
    rng, met = np.random.default_rng(26), 0
    for vocab in (2, 3, 1000):
        for _ in range(200):
            word = rng.integers(0, 2**63, vocab).astype(np.uint64)
            core = rng.integers(0, vocab, 40)
            texts = [word[np.concatenate([rng.integers(0, vocab, rng.integers(0, 9)), core, rng.integers(0, vocab, rng.integers(0, 9))])] for _ in range(2)]
            runs = [passages.shingles(t, passages.SEED) for t in texts]
            seeds = [passages.minimizers(r, passages.WINDOW) for r in runs]
            sides = [passages.beside(t, at) for t, at in zip(texts, seeds)]
            place, bits = passages.places(runs[0], seeds[0]), (1 << passages.STEP) - 1
            assert (place >> 2 * passages.STEP == seeds[0]).all()
            for side, step in ((0, -(place >> passages.STEP & bits)), (1, place & bits)):
                for i, k in enumerate(step.tolist()):
                    for j in np.flatnonzero((runs[1][seeds[1]] == runs[0][seeds[0][i]]) & (sides[1][side] == sides[0][side][i])):
                        at = seeds[1][j] + k
                        assert seeds[0][i] + k in seeds[0] and at in seeds[1] and runs[1][at] == runs[0][seeds[0][i] + k]
                        met += k != 0
    assert met > 5_000


def test_joined_seeds_of_texts_that_go_on_repeating_a_few_words(spark, monkeypatch):
    rng, tables, table = random.Random(27), {}, passages.Scratch.table
    texts = [fresh(rng, 20) + ["is", "so"] * 150 + fresh(rng, 20) for _ in range(20)]
    monkeypatch.setattr(passages.Scratch, "table", lambda self, df, name: tables.setdefault(name, table(self, df, name)))
    monkeypatch.setattr(passages.Scratch, "drop", lambda *_: None)
    assert spans_of(spark, texts) == {i: [(20, 320)] for i in range(1, 20)}
    for side in ("left", "right"):  # few, and not each of the 150 occurrences a text
        assert tables["shared"].join(tables[f"others-{side}"], ["value", side]).count() <= 10 * len(texts)


def test_seeds_that_are_not_joined_lose_nothing(spark, monkeypatch):
    rng, texts = random.Random(28), []
    pool = [fresh(rng, rng.randint(30, 90)) for _ in range(10)] + [["is", "so"] * 60, ["is", "so", "it"] * 40]
    for _ in range(60):
        text = [w for _ in range(rng.randint(1, 4)) for w in (rng.choice(pool) if rng.random() < 0.6 else fresh(rng, rng.randint(5, 40)))]
        texts.append([fresh(rng, 1)[0] if rng.random() < 0.04 else w for w in text])
    got = spans_of(spark, texts)
    monkeypatch.setattr(passages, "_not_led_to", lambda others, first: others)
    assert got == spans_of(spark, texts) and len(got) > 30


def test_chains_are_collinear_and_best():
    rng = random.Random(4)
    for _ in range(50):
        n = rng.randint(1, 12)
        x, y = np.array([rng.randrange(0, 300) for _ in range(n)]), np.array([rng.randrange(0, 300) for _ in range(n)])
        found = passages.chains(x, y)
        assert sum(len(c) for c in found) >= 1
        for c in found:
            assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(c, c[1:]))


def test_ends_extended_together_are_those_extended_one_by_one():
    rng, own, other, at = random.Random(26), [], [], []
    for _ in range(300):
        one = [rng.randrange(rng.choice([5, 400])) for _ in range(rng.choice([0, 3, 40, 128]))]
        rate, two = rng.choice([0, 0.05, 0.3, 0.7]), []
        for w in one:
            two += [w] if rng.random() >= rate else rng.choice([[], [999], [w, 998]])
        at.append((len(own), len(one), len(other), len(two)))
        own, other = own + one, other + two
    own, other, (a, n, b, m) = np.array(own), np.array(other), np.array(at).T
    ahead, back = passages.extensions_of_all(own, other, a, n, b, m, 1), passages.extensions_of_all(own, other, a + n - 1, n, b + m - 1, m, -1)
    for k, (i, size, j, length) in enumerate(at):
        one, two = own[i : i + size], other[j : j + length]
        assert sum(passages.extensions(one, two), ()) == tuple(ahead[k])
        assert sum(passages.extensions(one[::-1], two[::-1]), ()) == tuple(back[k])


def test_alignment_helpers():
    a = np.array([1, 2, 3, 4, 5, 6])
    assert passages.agreeing(a, np.array([1, 9, 3, 5, 6])) == 4 and passages.extend(a, np.array([1, 2, 3, 9, 9, 9])) == 3
    assert passages.merge([(0, 30), (20, 60), (80, 90)], 50) == [(0, 60)]


# --- 7 -----------------------------------------------------------------------


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "<|im_end|>\n&lt; [INST]"), (1, 2, "assistant", "</s> &amp;"), (1, 3, "user", "é\n"), (1, 4, "assistant", ""), (2, 0, "user", "only"), (3, 0, "assistant", "a"), (3, 1, "tool\nx<", None), (4, 0, None, "t"), (None, None, "assistant", "n"), (5, 1, "assistant", "r"), (5, 1, "assistant", "r")]
    table = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    examples = chat.expand(table)
    got = {r["conv_id"]: r for r in chat.digests(examples).collect()}
    for c in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in rows if r[0] == c]
        said, loss = "".join(f"{a}\n{b}\n" for a, b in turns), "".join(b for a, b in turns if a == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert examples.where("conv_id = 1").count() == 2 and examples.where("conv_id = 2 and loss_length = 0").count() == 1
    assert chat.digests(chat.expand(table.where("false"))).count() == 0


# --- 8, 9 and 10 -------------------------------------------------------------

SYLLABLES = {"en": ["the", "ing", "tion", "er", "wh"], "de": ["sch", "ung", "ä", "der", "ß"], "fr": ["eau", "é", "que", "ou", "le"]}


def spoken(lang, rng, n=40):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def multilingual(spark, n=150):
    rng = random.Random(8)
    rows = [(i, spoken(lang, rng), lang, "s", 1) for i in range(n) for lang in [("en", "de", "fr")[i % 3]]]
    return spark.createDataFrame(rows + [(n + i, t, None, "s", 1) for i, t in enumerate([*ODD, "123 !!"])], DOCS)


def test_language_of_unseen_texts(spark):
    docs = multilingual(spark)
    model = language.train(docs.where("doc_id % 4 <> 2"))
    assert np.count_nonzero(model.weights) < 0.5 * model.weights.size  # sparse
    got = {r["doc_id"]: r for r in language.identify(clashing(docs), model).collect()}
    wrong = [i for i in range(2, 150, 4) if got[i]["lang_pred"] != ("en", "de", "fr")[i % 3]]
    assert len(wrong) <= 1 and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(got[i]["lang_pred"] == "und" for i in (150, 151, 152, 153, 163)) and got[154]["lang_pred"] != "und"
    blank = language.train(docs.where("false"))
    assert {r["lang_pred"] for r in language.identify(docs, blank).collect()} == {"und"}
    assert language.identify(docs.where("false"), model).count() == 0
    assert same_extras(language.identify(clashing(docs), model).collect(), ("score", "lang_pred"))


def test_grams_against_plain_counts():
    texts = [t or "" for t in ODD] + ["Ab, c", "x1y  ÄÖ", "İx", "...", "a" * 50]
    places, counts, has = language.grams(texts)
    at, of = 0, {}
    for t, n, letter in zip(texts, counts.tolist(), has.tolist()):
        low = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in t)
        low = re.sub(" +", " ", low).lstrip()
        wanted = Counter(low[i : i + k] for i in range(len(low)) for k in (1, 2, 3) if i + k <= len(low))
        assert letter == any(c.isalpha() for c in t) and n == sum(wanted.values()), t
        got = Counter(places[at : at + n].tolist())
        assert sorted(got.values()) == sorted(wanted.values()), t  # hashed places, no two grams of so short a text in one
        for gram in set(wanted):
            of.setdefault(gram, language.grams([gram])[0])
        at += n


def test_regression_is_plain_ftrl():
    rng = np.random.default_rng(3)
    rows = [(np.sort(rng.choice(30, 6, replace=False)), rng.random(6)) for _ in range(40)]
    labels = rng.integers(0, 3, 40)
    z, n = np.zeros((3, 30)), np.zeros((3, 30))

    def weight(c, j):
        if abs(z[c, j]) <= language.L1:
            return 0.0
        return -(z[c, j] - np.sign(z[c, j]) * language.L1) / ((language.BETA + n[c, j] ** 0.5) / language.ALPHA + language.L2)

    order = np.random.default_rng(7)
    for _ in range(2):
        for i in order.permutation(40):
            at, x = rows[i]
            w = {(c, j): weight(c, j) for c in range(3) for j in at}
            logits = np.array([sum(w[c, j] * v for j, v in zip(at, x)) for c in range(3)])
            p = np.exp(logits) / np.exp(logits).sum()
            for c in range(3):
                for j, v in zip(at, x):
                    g = (p[c] - (labels[i] == c)) * v
                    s = ((n[c, j] + g * g) ** 0.5 - n[c, j] ** 0.5) / language.ALPHA
                    z[c, j] += g - s * w[c, j]
                    n[c, j] += g * g
    plain = np.array([[weight(c, j) for j in range(30)] for c in range(3)])
    assert np.allclose(language.ftrl(rows, labels, 3, 30, epochs=2), plain)


def test_repeated_ids_teach_once(spark, monkeypatch):
    docs = multilingual(spark, 60)
    again = docs.unionByName(docs.where("doc_id = 1")).unionByName(docs.where("doc_id = 1"))
    learned, plain = [], language.ftrl
    monkeypatch.setattr(language, "ftrl", lambda rows, *a: learned.append(len(rows)) or plain(rows, *a))
    assert language.train(docs).langs == language.train(again).langs == ["de", "en", "fr"]
    assert learned[0] == learned[1] <= 60
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    other = again.unionByName(docs.where("doc_id = 2").withColumn("text", F.lit("another text of that id")))
    a, b = quality.train(again, labels), quality.train(docs, labels)
    assert all(np.allclose(a.p[k], b.p[k]) for k in a.p) and quality.train(other, labels) is not None


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    logits = rng.normal(size=(4000, 3))
    labels = np.array([rng.choice(3, p=p) for p in language.softmax(logits)])
    assert abs(language.fit_temperature(logits * 5, labels) - 5) < 0.6


def plain_descent(n, p, goal):
    """The same projected gradient descent, with NumPy."""
    rate, present = np.ones(len(n)), (n[:, None] * p).sum(0)
    size = np.maximum(np.maximum(goal, present), 1.0)
    for _ in range(mixing.STEPS):
        error = ((rate * n)[:, None] * p).sum(0) - goal
        if np.abs(error / size).max() < mixing.CLOSE:
            break
        rate = np.maximum(0, rate - (p * error / present).sum(1))
    return rate


def test_descent_with_rates_at_zero(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.3] * 4, 300)
    n = rng.integers(0, 200, 300)
    rows = [(int(i), int(i), int(n[i]), *map(float, p[i])) for i in range(300)]
    members = spark.createDataFrame(rows, "doc_id long, h long, tokens long, p0 double, p1 double, p2 double, p3 double").coalesce(1)
    targets = {"a": 0.9, "b": 0.1, "c": 0.0, "d": 0.0}
    rated, _ = mixing.fit_rates(members, list("abcd"), targets, Scratch(spark, "test"), 9000.0)
    found = {r["doc_id"]: r["rate"] for r in rated.collect()}
    wanted = plain_descent(n, p, np.array([8100.0, 900.0, 0.0, 0.0]))
    assert np.allclose([found[i] for i in range(300)], wanted, atol=1e-9) and (wanted == 0).any()


def test_rates_meet_targets(spark):
    docs = multilingual(spark)
    labelled = docs.where("doc_id % 2 = 0").select("doc_id", F.col("lang").alias("domain"))
    rates = mixing.mix(clashing(docs), labelled, {"en": 0.5, "de": 0.3, "fr": 0.2}, total=20000.0)
    rows = rates.collect()
    assert len(rows) == docs.count() and all(r["rate"] >= 0 for r in rows)
    scratch = Scratch(spark, "test")
    domains, priors, model = mixing.fit_domains(docs, labelled, scratch)
    members = scratch.table(mixing.memberships(docs, domains, priors, model).coalesce(1), "members")
    targets = {"en": 0.5, "de": 0.3, "fr": 0.2}
    rated, errors = mixing.fit_rates(members, domains, targets, scratch, 20000.0)
    assert max(map(abs, errors)) < 1e-3
    data = [(r["tokens"], np.array([r[f"p{k}"] for k in range(3)]), r["rate"]) for r in rated.collect()]
    assert all(abs(p.sum() - 1) < 1e-9 for _, p, _ in data)
    n, p, found = (np.array(x) for x in zip(*data))
    assert np.allclose(found, plain_descent(n, p, np.array([20000.0 * targets[d] for d in domains]))) and (found == 0).sum() == 0
    assert abs((found * n).sum() - 20000) < 20
    tokens = {r["doc_id"]: r["tokens"] for r in rows}
    assert tokens[150] == 0 and tokens[0] == 40
    kept = mixing.resample(clashing(docs), rates)
    assert kept.columns == clashing(docs).columns and same_extras(kept.collect()) and kept.count() == sum(r["copies"] for r in rows)
    same = mixing.mix(docs, labelled.where("false"), {"en": 1.0}).select("rate").distinct().collect()
    assert [r[0] for r in same] == [1.0]
    assert mixing.mix(docs.where("false"), labelled, {"en": 1.0}).count() == 0


def test_rates_of_a_rare_domain_meet_its_target(spark):
    rows = [(i, 100, *((0.001, 0.999) if i % 100 == 0 else (0.999, 0.001))) for i in range(1000)]
    members = spark.createDataFrame(rows, "doc_id long, tokens long, p0 double, p1 double").coalesce(1)
    _, errors = mixing.fit_rates(members, ["en", "es"], {"en": 0.5, "es": 0.5}, Scratch(spark, "test"))
    assert max(map(abs, errors)) < mixing.CLOSE


def test_many_domains_and_too_many(spark, monkeypatch):
    rows = [(i, f"w{i % 70} w{i % 70} common", "en", f"s{i % 70}", 3) for i in range(280)]
    docs = spark.createDataFrame(rows, DOCS)
    labelled = mixing.labelled_documents(docs, docs.select("doc_id"), "source")
    domains, priors, model = mixing.fit_domains(docs, labelled, Scratch(spark, "test"))
    assert domains == sorted({r[3] for r in rows}) and abs(sum(priors) - 1) < 1e-9
    monkeypatch.setattr(mixing, "DOMAINS", 69)
    with pytest.raises(ValueError, match="69 domains"):
        mixing.fit_domains(docs, labelled, Scratch(spark, "test"))


def test_no_listed_domain_shrinks_by_default():
    assert mixing.goal_tokens(["a", "b"], [100.0, 10.0], {"a": 0.5, "b": 0.5}, None) == [102.0, 102.0]
    assert mixing.goal_tokens(["a", "b"], [100.0, 10.0], {"a": 1.0}, 50.0) == [50.0, 10.0]


def test_quality_of_unseen_texts(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(200):
        good = i % 4 > 0
        words = spoken("en", rng, rng.randint(5, 300)).split()
        rows.append((i, " ".join(w if good else w.upper() + "!!" for w in words), "en", "s", 1))
        labels.append((i, int(good)))
    docs = spark.createDataFrame(rows + [(1000 + i, t, None, "s", 1) for i, t in enumerate(ODD)], DOCS)
    table = spark.createDataFrame([*labels, (1, None), (None, 1), (7, 5)], "doc_id long, quality int")
    net = quality.train(docs, table.where("doc_id % 5 <> 0"))
    got = {r["doc_id"]: r for r in quality.score(clashing(docs), net).collect()}
    assert sum(got[i]["predicted"] != (i % 4 > 0) for i in range(0, 200, 5)) <= 1
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == 200 + len(ODD)
    assert quality.train(docs, table.where("false")) is None
    assert same_extras(quality.score(clashing(docs), net).collect(), ("score", "predicted"))
    assert {r["score"] for r in quality.score(docs, None).collect()} == {0.5}


def test_passage_features_against_plain_counts():
    texts = [*ODD, "one two two one two two THREE 4!  " * 40, "Ünï cödé | bar. " * 30]
    x, parts = quality.encode(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"]))
    kinds, at = quality._CLASS, 0
    for t, n in zip(texts, parts.tolist()):
        raw = (t or "").encode()
        spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
        words = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), raw[a:b]) for a, b in spans]
        assert n == max(1, -(-len(words) // quality.WORDS))
        for k in range(n):
            mine = range(k * quality.WORDS, min((k + 1) * quality.WORDS, len(words)))
            begin = 0 if k == 0 else spans[mine[0]][0]
            end = spans[mine[-1] + 1][0] if mine and mine[-1] + 1 < len(words) else len(raw)
            pairs = Counter((kinds[a], kinds[b]) for a, b in zip(raw[begin:end], raw[begin + 1 : end]))
            row = np.zeros(quality.FEATURES)
            for (a, b), c in pairs.items():
                row[a * quality.CLASSES + b] = c / sum(pairs.values())
            if mine:
                sizes = [spans[i][1] - spans[i][0] for i in mine]
                runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
                row[-6], row[-5] = np.mean(sizes) / 10, min(np.std(sizes) / 10, 5)
                row[-4] = sum(words[i] in [words[j] for j in mine if j < i] for i in mine) / len(mine)
                row[-3] = sum(words[i] in words[:i] for i in mine) / len(mine)
                row[-2] = sum(i < len(runs) and runs[i] in runs[:i] for i in mine) / len(mine)
            row[-1] = np.log1p(len(words)) / 10
            assert np.allclose(x[at], row, atol=1e-5), (t, k, np.flatnonzero(~np.isclose(x[at], row, atol=1e-5)))
            at += 1


def test_passages_are_bounded_before_they_are_fetched(spark, monkeypatch):
    docs = documents(spark, [spoken("en", random.Random(i), 64 * 9) for i in range(30)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "PASSAGES", 100)
    taken = []
    monkeypatch.setattr(quality, "fit", lambda bags, y: taken.append((len(bags), sum(map(len, bags)), len(y))))
    quality.train(docs, labels)
    assert taken == [(11, 99, 11)]


def test_network_gradient():
    rng = np.random.default_rng(0)
    net, x, parts = quality.Network(6), rng.normal(size=(9, 6)), np.array([2, 4, 3])
    d = rng.normal(size=3)
    _, kept = net.forward(x, parts)
    grads = net.gradient(d, kept)
    for name, p in net.p.items():
        at = tuple(0 for _ in p.shape)
        old, eps = p[at], 1e-6
        values = []
        for sign in (1, -1):
            p[at] = old + sign * eps
            values.append(float(d @ net.forward(x, parts)[0]))
        p[at] = old
        assert abs((values[0] - values[1]) / (2 * eps) - grads[name][at]) < 1e-5


def test_pipeline_stages_follow_one_another(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    texts = [spoken("en", rng, rng.randint(60, 120)) for _ in range(60)] + [spoken("de", rng, 50).upper().replace(" ", "!! ") + "!!" for _ in range(20)]
    texts += [texts[0], texts[1] + " more", *ODD]
    docs = documents(spark, texts).coalesce(2)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 60)) for i in range(80)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    now, columns = spark.read.parquet(str(tmp_path / "documents.parquet")), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = Scratch(spark, "test").table(stage(spark, now, str(tmp_path)), name)
        assert now.columns == columns
        ids = Counter(r["doc_id"] for r in now.collect())
        assert set(range(60)) <= set(ids), name  # clean documents stay
        assert not any(60 <= i < 80 for i in ids), name
        if name != "quality_classifier":
            assert 80 not in ids
    kept = corpus_pipeline.keep_quality(spark, clashing(docs), str(tmp_path))
    assert kept.columns == clashing(docs).columns and same_extras(kept.collect())
    last = corpus_pipeline.run(spark, str(tmp_path))
    assert set(last.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} and last.count() >= now.count()


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    documents(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
