"""Each text operator against a plain version, and on its defined corner cases."""

import hashlib
import os
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.llm import chat, jaccard, packing, pii, resampling, shingling, warc
from corvane.llm.bpe import decoded, encoded, round_trip
from corvane.llm.jaccard import boundary_by_cost, jaccard_components
from corvane.llm.quality import with_quality
from corvane.llm.sharding import MULTIPLIER, sharded
from corvane.llm.toxicity import with_toxicity

SF = "/root/testdata/sf0.1"
CLASHING = ("n", "sid", "id", "node", "score", "block", "payload", "comp", "bucket", "label", "_n")


def documents(spark, texts, ids=None, **columns):
    """A documents table with extra columns whose names the operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    df = spark.createDataFrame([(i, t, "en", f"src{k % 3}", 0) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASHING:
        df = df.withColumn(c, F.lit("x"))
    return df


CORNERS = [None, "", "  \t\n", "one", "One  TWO three", "one two three", "a b c d e", "A B C D E", "x " * 30_000, "é ü ß 你好 🎉 " * 3, "same text here again now", "same text here again now"]


# ---- n-gram Jaccard join


def plain_sets(texts, k=5):
    out = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def plain_components(ids, texts):
    sets = plain_sets(texts)
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(ids)
    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = defaultdict(lambda: 1 << 60)
    for i, d in enumerate(ids):
        least[find(i)] = min(least[find(i)], d)
    return {d: (len(sets[i]), least[find(i)] if sets[i] else d, links[i]) for i, d in enumerate(ids)}


def near_copies(seed=4):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    passage = [r.choice(vocab) for _ in range(60)]
    texts = []
    for size in (3, 5, 6, 8, 9, 12, 20, 40, 80, 200):
        base = [r.choice(vocab) for _ in range(size)]
        for _ in range(14):
            w = list(base)
            for _ in range(r.randint(0, max(1, size // 30))):
                w[r.randrange(len(w))] = r.choice(vocab)
            texts.append(" ".join(w))
        texts.append(" ".join(base + passage))
    r.shuffle(texts)
    return texts + [c for c in CORNERS if c is None or len(c) < 1000]


@pytest.mark.parametrize("options", [{}, {"boundary": 0}, {"boundary": 30}, {"job_sets": 3, "list_sets": 2, "block_sets": 3}, {"job_sets": 3, "list_sets": 6, "block_sets": 500, "boundary": 10}])
def test_jaccard_against_all_pairs(spark, options):
    texts = near_copies()
    ids = [1000 - 3 * i for i in range(len(texts))]
    df, want = documents(spark, texts, ids), plain_components(ids, texts)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_components(df, **options, count_links=True).collect()}
    assert got == want
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, **options).collect()}
    assert got == {d: w[:2] for d, w in want.items()}


def test_jaccard_joins_a_chain_of_near_copies(spark):
    """A large component in which most sets link with few others: hubs leave much over, and nothing may be lost."""
    r = random.Random(7)
    words = [f"w{r.randrange(5000)}" for _ in range(400)]
    texts = [" ".join(words[3 * k : 3 * k + 60]) for k in range(100)] + [" ".join(r.sample(words, 50)) for _ in range(20)]
    ids = list(range(len(texts)))
    want = {d: w[1] for d, w in plain_components(ids, texts).items()}
    assert list(want.values()).count(0) == 100
    got = {r.doc_id: r.component_id for r in jaccard_components(documents(spark, texts, ids), job_sets=8, block_sets=4, list_sets=3).collect()}
    assert got == want


def forms(n):
    """Form letters: twelve fixed words and one of their own, at the end or in the middle."""
    words = [f"form{k}" for k in range(12)]
    return [" ".join([*words, f"own{i}"] if i % 3 else [*words[:6], f"own{i}", *words[6:]]) for i in range(n)]


def test_jaccard_spreads_frequent_pairs(spark):
    texts = forms(400) + near_copies()[:40]
    ids = list(range(len(texts)))
    df, want = documents(spark, texts, ids), plain_components(ids, texts)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_components(df, count_links=True).collect()}
    assert got == want
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df).collect()}
    assert got == {d: w[:2] for d, w in want.items()}


def test_no_bucket_holds_the_postings_of_a_template():
    batch = pa.RecordBatch.from_arrays([pa.array(forms(6000))], names=["text"])
    counts = np.zeros(1 << jaccard.SKETCH_BITS, np.int64)
    data, offs = shingling.text_buffer(batch.column(0))
    for s in shingling.shingle_sets(data, offs, 5):
        np.add.at(counts, (s >> np.uint64(64 - jaccard.SKETCH_BITS)).astype(np.int64), 1)
    levels = np.where(counts > 4, np.floor(np.log2(np.maximum(counts, 1) / 4)) + 1, 0).clip(0, 255).astype(np.uint8)
    held = np.zeros((2, 50), np.int64)
    for out in jaccard._postings(5, 80, lambda: levels, 64, 50)([batch]):
        for lane, hot, payload in zip(*(c.to_pylist() for c in out.columns), strict=True):
            held[int(hot), lane] += len(payload) // jaccard.POSTING.itemsize
    assert held.sum() > 6000 and (held.max(1) <= 2 * np.median(held, 1)).all()


def test_jaccard_corners(spark):
    assert jaccard_components(documents(spark, ["x"]).limit(0)).count() == 0
    rows = jaccard_components(documents(spark, ["a b c d e f", "a b c d e f", "a b c d e f", None], [None, 7, 7, None]), count_links=True).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.n_links) for r in rows) == [(-1, 0, -1, 0), (-1, 2, 7, 2), (7, 2, 7, 2), (7, 2, 7, 2)]


def test_boundary_follows_cost():
    assert boundary_by_cost({5: 1000, 40: 1000, 65: 10}, 500.0, 80) > boundary_by_cost({5: 1000, 40: 1000, 65: 10}, 0.0, 80)


def test_word_bounds_on_every_text_split():
    import numpy as np
    import pyarrow as pa

    r = random.Random(1)
    texts = ["".join(r.choice("ab \n\tÉ") for _ in range(r.randint(0, 9))) for _ in range(400)]
    data, offs = shingling.text_buffer(pa.array(texts))
    words, before = shingling.word_hashes(data, offs)
    assert np.diff(before).tolist() == [len([x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]) for t in texts]
    flat = [w for t in texts for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    assert len({(w, int(h)) for w, h in zip(flat, words, strict=True)}) == len(set(flat)) == len(set(words.tolist()))


# ---- byte-level BPE


@pytest.fixture(scope="module")
def codec_args():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN


def test_bpe_as_tiktoken(spark, codec_args):
    import tiktoken

    from corvane.llm.bpe import read_ranks

    plain = tiktoken.Encoding("own", pat_str=codec_args[1], mergeable_ranks=read_ranks(codec_args[0]), special_tokens={})
    r = random.Random(3)
    texts = CORNERS + ["".join(r.choice("ab é\n 12'st�ſ你🎉 <|endoftext|>") for _ in range(r.randint(0, 60))) for _ in range(300)] + ["   lead", "don't we'll", "z" * 5000]
    df = documents(spark, texts)
    ids = {r.doc_id: r for r in encoded(df, *codec_args).collect()}
    digests = {r.doc_id: r for r in round_trip(df, *codec_args).collect()}
    for i, t in enumerate(texts):
        want = plain.encode_ordinary(t or "")
        assert ids[i].ids == want
        assert digests[i].n_tokens == len(want)
        assert digests[i].ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in want)).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
        assert all(s <= e for s, e in zip(ids[i].starts, ids[i].ends, strict=True))
        assert not want or (ids[i].starts[0] == 0 and ids[i].ends[-1] == len(t))
    back = {r.doc_id: r.text for r in decoded(encoded(df, *codec_args), *codec_args).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}


def test_bpe_decodes_a_cut_character(spark, codec_args):
    df = encoded(documents(spark, ["🎉"]), *codec_args).withColumn("ids", F.slice("ids", 1, 1))
    assert decoded(df, *codec_args).first().text == "�"
    assert round_trip(documents(spark, ["x"]).limit(0), *codec_args).count() == 0


# ---- chat formatting


def talks(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash")).withColumn("turns", F.lit(1))


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "~1 ~0 ~", "[ESC]", "<s", "/s>", "</", "", None, "plain", "<s>[ESC][INST]user[/INST]x</s>", "~0</s>", "é🎉 </s>", "x" * 50_000]
    roles = ["user", "assistant", "system", "[/INST]", None, ""]
    rows = [(c, t, roles[(c + t) % len(roles)], hard[(c * 5 + t) % len(hard)]) for c in range(len(hard)) for t in range(5)] + [(None, 1, "user", "a"), (None, None, "user", "first"), (3, 1, "assistant", "tie"), (3, 1, "assistant", "tie")]
    out = {r.conv_id: r for r in chat.digests(chat.formatted(talks(spark, rows))).collect()}
    want = defaultdict(list)
    for c, t, role, text in rows:
        want[c].append((-(1 << 62) if t is None else t, role or "", text or ""))
    assert set(out) == set(want)
    for c, turns in want.items():
        turns.sort()
        story = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = out[c]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256(story.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_escapes_only_what_conflicts(spark):
    out = {r.conv_id: r.formatted for r in chat.formatted(talks(spark, [(1, 0, "user", "a ~ b"), (2, 0, "user", "a </s> ~")])).collect()}
    assert out == {1: "<s>[INST]user[/INST]a ~ b</s>", 2: "<s>[ESC][INST]user[/INST]a ~2 ~0</s>"}
    assert chat.formatted(talks(spark, [(1, 0, "a", "b")]).limit(0)).count() == 0


# ---- sharding


def plain_jump(key, shards):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * MULTIPLIER + 1) & ((1 << 64) - 1)
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding(spark):
    r = random.Random(5)
    ids = list(range(500)) + [-1, -(1 << 63), (1 << 63) - 1, None] + [r.getrandbits(63) for _ in range(200)] + [3] * 40
    df = documents(spark, [f"text {i}" if i and i % 7 else None for i in ids], ids)
    out = sharded(df, 24, bucket_rows=5).collect()
    assert len(out) == len(ids)
    slots = defaultdict(list)
    for row in out:
        assert row.shard == plain_jump(row.doc_id or 0, 24) and row.grown_shard in (row.shard, 24) and row.law == "key"
        assert row.grown_shard == plain_jump(row.doc_id or 0, 25)
        text = f"text {row.doc_id}" if row.doc_id and row.doc_id % 7 else ""
        assert row.size == len(text) + 8 and row.text_crc32 == zlib.crc32(text.encode())
        slots[row.shard].append(row.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharded(df.limit(0), 24).count() == 0


# ---- personal data

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            if k == 1 and not all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and not (12 <= len(digits) <= 19 and pii.luhn(digits)) or k == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_against_patterns():
    r = random.Random(9)
    for _ in range(20_000):
        t = "".join(r.choice("a@.@-b+1 2 (3)0.5%4") for _ in range(r.randint(0, 34)))
        assert pii.detect(t) == plain_spans(t), t


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("mail joe dot smith [at] example dot com now", "email:5:39"),
        ("write to bob at mail dot example dot org please", "email:9:40"),
        ("call plus one two six nine five five five three two nine six", "phone:5:60"),
        ("ip 192 dot 168 dot 1 dot 10 ok", "ip:3:27"),
        ("jоhn@exаmple.com", "email:0:16"),
        ("a@b.co and x (at) y (dot) net", "email:0:6,email:11:29"),
        ("contact john at example.com", "email:8:27"),
        ("meet me at example.com", ""),
        ("john_at_example_dot_com", "email:0:23"),
        ("jo [at] example punkt de", "email:0:24"),
        ("marie arobase exemple point fr", "email:0:30"),
        ("pepe (arroba) correo (punto) es", "email:0:31"),
        ("alice dot smith@example.com", "email:0:27,email:10:27"),
        ("10 point 0 point 0 point 1", "ip:0:26"),
        ("four, 111 1111, 1111 1111 1", ""),
        ("card four, one, one, one 1111 1111 1111", "card:5:39"),
        ("٤111 1111 1111 1111 x ١٠.٠.٠.١", "card:0:19,ip:22:30"),
        ("look at the dot on it", ""),
        ("one or two or three", ""),
        ("", ""),
    ],
)
def test_disguises_map_back(text, spans):
    base, more = pii.find(text)
    assert pii.written_out(base + more) == spans


@pytest.mark.parametrize("lead", ["", "Card:\n", "card (", "card "])
def test_one_spelled_digit_opens_the_run(lead):
    _, more = pii.find(lead + "four 111 1111 1111 1111")
    assert [(s, k) for s, k, *_ in more] == [(len(lead), 2)]


def test_pii_takes_time_in_proportion():
    import time

    for text in (" call one of " + "12 " * 80_000, "one " * 80_000, "a_at_" * 40_000, "at dot " * 40_000, "a.a at " * 30_000, "(at)" * 50_000, "٤" * 80_000):
        began = time.perf_counter()
        pii.find(text)
        assert time.perf_counter() - began < 1


def test_transducers_against_a_plain_one():
    """Made of parts whose normal form is known, the normalised text and every character's source are as put together."""
    r = random.Random(12)
    parts = [("bob", "bob"), (" (at) ", "@"), (" [dot] ", "."), ("ex-1", "ex-1"), ("о", "o"), ("٣", "3"), ("\u200b", ""), ("；", ";"), ("Ａ", "A")]
    for _ in range(2000):
        chosen = [parts[0], parts[1], parts[3], parts[2], parts[0]] if r.random() < 0.3 else [r.choice([p for p in parts if p[0][0] != " "]) for _ in range(6)]
        text, want, start, end = "", "", [], []
        for src, out in chosen:
            for k, c in enumerate(out):
                want += c
                start.append(len(text) + (k if len(src) == len(out) else 0))
                end.append(len(text) + (k + 1 if len(src) == len(out) else len(src)))
            text += src
        t = pii.normalised(text, {"odd", "spelled", "disguised", "bare"})
        assert (t.text, t.start.tolist(), t.end.tolist()) == (want, start, end), text


def test_pii_rows(spark):
    texts = CORNERS + ["x a.b@c.de y 10.0.0.1", "4111 1111 1111 1111", "+1 (269) 555-3296", "9" * 20_000, "@" * 5000, "a" * 20_000 + "@"]
    out = {r.doc_id: r for r in pii.pii_spans(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = plain_spans(t or "") if len(t or "") < 19_000 else []
        assert out[i].base_sha256 == hashlib.sha256(pii.written_out(want).encode()).hexdigest()
        assert [out[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == k for s in want) for k in range(4)]
    clean = {r.doc_id: r.text for r in pii.with_pii_redacted(documents(spark, texts)).collect()}
    assert clean[len(CORNERS)] == "x <EMAIL> y <IP>" and clean[0] is None


# ---- packing


def plain_best_fit(items, capacity):
    bins = []
    for size, source, cluster in items:
        fit = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= size and source not in b["sources"] and cluster not in b["clusters"]]
        if not fit:
            bins.append({"left": capacity, "sources": set(), "clusters": set()})
        k = min(fit)[1] if fit else len(bins) - 1
        bins[k]["left"] -= size
        bins[k]["sources"].add(source)
        bins[k]["clusters"].add(cluster)
        yield k


@pytest.mark.parametrize("hot", [0.0, 0.5])
def test_best_fit_is_tightest(hot):
    r = random.Random(8)
    items = [(r.randint(1, 100), "hot" if r.random() < hot else f"s{r.randrange(60)}", r.randrange(150)) for _ in range(400)]
    bins, _ = packing.pack([i[0] for i in items], [i[1] for i in items], [i[2] for i in items], 100)
    assert bins == list(plain_best_fit(items, 100))


def test_packing_keeps_everything(spark):
    texts = CORNERS + [f"t{i} " * (i % 40) for i in range(150)] + ["copy"] * 30
    df = documents(spark, texts, [i // 2 for i in range(len(texts))])
    rows = packing.packed(df, capacity=64, block_pieces=50).collect()
    assert sum(r.size for r in rows) == sum(len((t or "").encode()) + 1 for t in texts)
    source = defaultdict(list)
    for row in rows:
        source[row.bin_id].append((row.bin_offset, row.size))
    for pieces in source.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        assert at <= 64
    assert packing.packed(df.limit(0)).count() == 0


@pytest.mark.parametrize("per_source", [1, 3])
def test_packed_keeps_conflicts_apart(spark, per_source):
    r = random.Random(2)
    texts = ["t" * r.randint(0, 120) if k % 4 else f"copy {k % 12}" for k in range(600)]
    df = documents(spark, texts).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("doc_id") % 17).cast("string"))))
    rows = packing.packed(df, capacity=100, per_source=per_source, block_pieces=150).join(df.select("doc_id", "text", "source"), "doc_id").collect()
    bins = defaultdict(list)
    for row in rows:
        bins[row.bin_id].append(row)
    for held in bins.values():
        sources, copies = [x.source for x in held], [x.text for x in held]
        assert max(map(sources.count, sources)) <= per_source and len(set(copies)) == len(copies)
        assert sum(x.size for x in held) <= 100


def test_one_source_fills_bins_where_it_may(spark):
    df = documents(spark, ["t" * (k % 37) for k in range(400)]).withColumn("source", F.lit("only")).withColumn("text", F.concat("text", F.col("doc_id").cast("string")))
    bins = {n: packing.packed(df, capacity=200, per_source=n).select("bin_id").distinct().count() for n in (1, 20)}
    assert bins[1] == 400 and bins[20] <= 1.1 * sum(k % 37 + len(str(k)) + 1 for k in range(400)) / 200 + 1


def test_workers_need_not_have_the_package(spark, tmp_path):
    """What tasks run is loaded and run by a plain Python that has nothing but the archive that executors are sent."""
    import subprocess
    import sys

    import pyarrow as pa
    from pyspark import SparkFiles, cloudpickle

    from corvane.llm import cluster, components

    cluster.ship_package(spark)
    archive = SparkFiles.get("corvane.zip")
    assert os.path.basename(archive) in spark.sparkContext._python_includes
    edges = pa.record_batch([pa.array([3, 9]), pa.array([2, 3])], names=["a", "b"])
    tasks = (components._forest, edges, packing._pack_block(100, 1), resampling._counting(1, 10), warc._writing(100, 10))
    (tmp_path / "tasks").write_bytes(cloudpickle.dumps(tasks))
    (tmp_path / "run.py").write_text(f"""
import pickle, sys
sys.path = [p for p in sys.path if not p.endswith("repo")]
sys.path.insert(0, {archive!r})
forest, edges, *others = pickle.load(open({str(tmp_path / "tasks")!r}, "rb"))
import corvane
assert corvane.__file__.startswith({archive!r}), corvane.__file__
print("ran", [b.to_pydict() for b in forest([edges])], sum(map(callable, others)))
""")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(tmp_path / "run.py")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.stdout.startswith("ran [{'u': [3, 9], 'v': [2, 2]}]"), done.stdout + done.stderr


# ---- classifiers


def crc(i, of):
    return zlib.crc32(str(i).encode()) % of


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize(("name", "of", "held", "least", "clean"), [("toxic", 4, 2, 0.96, 0.99), ("quality", 3, 1, 0.97, 0.99)])
def test_classifiers_on_held_out_rows(spark, name, of, held, least, clean):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    train = F.crc32(F.col("id").cast("string").cast("binary")) % of != held
    scored = (with_toxicity if name == "toxic" else with_quality)(docs, labels, score_col="p", train_where=train)
    rows = [r for r in scored.join(labels, "doc_id").select("doc_id", "p", F.col(name).alias("y")).collect() if crc(r.doc_id, of) == held]
    said = [(r.p >= (0.3 if name == "toxic" else 0.5)) == (r.y == 1) for r in rows]
    good = [s for s, r in zip(said, rows, strict=True) if r.y == (0 if name == "toxic" else 1)]
    assert sum(said) / len(said) >= least and sum(good) / len(good) >= clean


@pytest.mark.parametrize("with_score", [with_toxicity, with_quality])
def test_classifier_corners(spark, with_score):
    docs = documents(spark, CORNERS + ["good words here"] * 5)
    column = "toxic" if with_score is with_toxicity else "quality"
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, None), (5, 1), (None, 1), (6, 0), (99, 1)], f"doc_id long, {column} int")
    out = with_score(docs, labels, score_col="score").collect()
    assert len(out) == docs.count() and all(0 <= r.score_ <= 1 and r.score == "x" for r in out)
    assert {round(r.score, 6) for r in with_score(docs.drop("score"), labels.limit(0), score_col="score").collect()} == {0.5}
    assert with_score(docs.limit(0), labels, score_col="p").count() == 0


def test_ftrl_against_a_plain_one():
    """The vectorised learner against the published update, coordinate by coordinate; its weights are sparse."""
    import math

    import numpy as np

    from corvane.llm.toxicity import BITS, train

    r = random.Random(3)
    examples = [(k, np.array(sorted(r.sample(range(400), 12) + ([1000] if y else [])), np.int64), y) for k in range(300) for y in [int(r.random() < 0.2)]]
    at, w, bias = train(examples, epochs=2, alpha=0.7, beta=1.2, l1=1.5, l2=0.3)
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= 1.5 else -(z[i] - math.copysign(1.5, z[i])) / ((1.2 + math.sqrt(n[i])) / 0.7 + 0.3)

    for epoch in range(2):
        for k in np.random.default_rng(epoch).permutation(len(examples)):
            _, coords, y = examples[k]
            active = [*coords.tolist(), 1 << BITS]
            ws = {i: weight(i) for i in active}
            g = 1 / (1 + math.exp(-sum(ws.values()))) - y
            for i in active:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.7 * ws[i]
                n[i] += g * g
    want = {i: weight(i) for i in z if i < 1 << BITS and weight(i)}
    assert set(at.tolist()) == set(want) and np.allclose(w, [want[i] for i in at.tolist()]) and abs(bias - weight(1 << BITS)) < 1e-9
    assert 1000 in want and len(want) < 0.5 * len(z)


def test_non_negative_risk_against_differences():
    import numpy as np

    from corvane.llm import quality

    r = np.random.default_rng(1)
    xp, xu = r.integers(0, 40, (7, 5)), r.integers(0, 40, (9, 5))
    for prior, shift in ((None, 0.0), (0.3, 0.0), (0.9, 0.0), (0.9, -3.0)):
        w = r.normal(size=41)
        w[np.unique(xu)] += shift
        s = lambda w, x: 1 / (1 + np.exp(-(w[x].sum(1) + w[-1])))

        def risk(w, prior=prior, s=s):
            if prior is None:
                return -np.log(s(w, xp)).mean() - np.log(1 - s(w, xu)).mean()
            rest = s(w, xu).mean() - prior * s(w, xp).mean()
            return prior * (1 - s(w, xp)).mean() + rest if rest >= 0 else -rest

        g = quality.risk_gradient(w, xp, xu, prior)
        for i in range(41):
            step = np.zeros(41)
            step[i] = 1e-6
            assert abs((risk(w + step) - risk(w - step)) / 2e-6 - g[i]) < 1e-6


@pytest.mark.parametrize("share", [0.5, 0.7, 0.9])
def test_class_prior_of_planted_mixtures(share):
    import numpy as np

    from corvane.llm import quality

    r = np.random.default_rng(6)
    good = lambda n: np.hstack([r.normal(1, 1, (n, 6)), r.normal(0, 1, (n, quality.WIDTH - 6))])
    junk = lambda n: np.hstack([r.normal(-1, 1, (n, 6)), r.normal(0, 1, (n, quality.WIDTH - 6))])
    unlabelled = np.vstack([good(int(4000 * share)), junk(4000 - int(4000 * share))])
    _, _, prior = quality.fit(good(200), unlabelled[r.permutation(4000)])
    assert abs(prior - share) <= 0.12
