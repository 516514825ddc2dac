"""The registered queries against SQL, brute force, libraries and held-out labels."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import compare
import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from docloom.llm import bpe, components, language_model, packing, queries, quality_rules, simhash, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark, small):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, small, name):
    df = queries.QUERIES[name](spark, small)
    assert compare.differences(df, compare.connect(small), queries.ORACLES[name]) is None


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def test_rules_run_in_any_order(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    forward = {r.doc_id: r.kept for r in quality_rules.judge(docs).collect()}
    rows = quality_rules.measured(docs, "doc_id").withColumn("base_failed", quality_rules.base_failed())
    backward = rows.select("doc_id", quality_rules.rejected_by(quality_rules.RULES[::-1]).isNull().alias("kept"))
    assert forward == {r.doc_id: r.kept for r in backward.collect()}


# ---- packing --------------------------------------------------------------


def check_packing(rows, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    total = padding = 0
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end <= 2048
        total += end
        padding += 0 if end & (end - 1) == 0 else 2048 - end
    assert set(pieces) == set(texts)
    for doc_id, parts in pieces.items():
        ids = np.array([*tokenizer.encode(texts[doc_id] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            at += r.length
            assert zlib.crc32(ids[r.start:at].tobytes()) == r.ids_crc32
        assert at == len(ids)
    return padding / total


def test_packing_round_trip(spark, small, texts):
    assert check_packing(queries.op2_packing(spark, small).collect(), texts) < 0.01


@pytest.mark.parametrize("limits", [packing.Limits(64, 5, 40), packing.Limits(64, 256, 64), packing.Limits(32, 1, 8)])
def test_packer_holds_all_limits(limits):
    rng = np.random.default_rng(1)
    lengths, prompts = rng.integers(1, 200, 3000), rng.integers(0, 100, 3000)
    packer, rows = packing.Packer(limits, 0), []
    for doc, (n, prompt) in enumerate(zip(lengths.tolist(), prompts.tolist(), strict=True)):
        rows += packer.add(doc, n, prompt)
    rows += packer.close()
    by_sequence, by_doc = defaultdict(lambda: [0, 0, 0]), defaultdict(list)
    for doc, start, length, sequence, offset in rows:
        use = by_sequence[sequence]
        use[0] += length
        use[1] += 1
        use[2] += length - min(max(int(prompts[doc]) - start, 0), length)
        by_doc[doc].append((start, length))
    assert all(t <= limits.tokens and s <= limits.segments and x <= limits.loss for t, s, x in by_sequence.values())
    for doc, parts in by_doc.items():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [s for s, _ in sorted(parts)] == [0, *ends[:-1].tolist()] and ends[-1] == lengths[doc]


# ---- byte-level BPE -------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return bpe.Codec(ranks, public_tokenizers.PATTERN), library


def test_bpe_equals_library_on_odd_texts(codec):
    ours, library = codec
    odd = [
        "", "a", "  a  b \n\n c\t\t d", "a \n\nb", "it's  they'll\x1c x", "日本語テキスト \U0001F600\U0001F600",
        "ab" * 3000, "xyz" * 80, " " * 50 + "z", "\n \n  q", "é́ ÄÖ", "<|endoftext|> hi",
        "a \n\nb   c", "!" * 700, "Zażółć gęślą jaźń", "\u0085  　x",
    ]
    for text, found in zip(odd, ours.encode(odd), strict=True):
        ids = np.frombuffer(found, "<i4")
        assert ids.tolist() == library.encode_ordinary(text), text[:40]
        assert ours.decode([ids])[0] == text.encode()


def test_long_and_short_words_merge_alike(codec):
    ours, _ = codec
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("etaoinshr"), n)).encode() for n in range(2, 200)]
    found = [np.frombuffer(ids, "<i4").tolist() for ids in ours.merge(words)]
    assert found == [bpe.merge_long(w, ours.ranks) for w in words]


def test_bpe_query(spark, small, texts, codec):
    for r in queries.op3_byte_bpe(spark, small).collect():
        ids = codec[1].encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


# ---- classifiers ----------------------------------------------------------


def test_language_of_held_out_texts(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("driver tables not present")
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    held = [r for r in queries.op5_language_id(spark, folder).collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and 0 <= r.score <= 1 for r in held)
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) / len(held) > 0.97


def test_quality_and_toxicity_of_held_out_texts(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("driver tables not present")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    good = [r for r in queries.op7_quality_classifier(spark, folder).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.kept == bool(labels[r.doc_id].quality) for r in good) / len(good) > 0.93
    rows = [r for r in queries.op10_toxicity(spark, folder).collect() if r.held_out and r.doc_id in labels]
    clean = [r for r in rows if not labels[r.doc_id].toxic]
    toxic = [r for r in rows if labels[r.doc_id].toxic]
    assert np.mean([r.predicted for r in clean]) < 0.05
    assert np.mean([r.score for r in toxic]) > np.mean([r.score for r in clean]) + 0.3


def test_maximal_segments_equal_recursive_definition():
    def slow(scores, at=0):
        """The best segment (shortest, leftmost), then the same left and right of it."""
        best = max(
            ((sum(scores[i:j]), i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)),
            key=lambda x: (round(x[0], 9), x[1] - x[2], -x[1]), default=(0, 0, 0),
        )
        if best[0] <= 1e-9:
            return []
        s, i, j = best
        return slow(scores[:i], at) + [(at + i, at + j - 1, s)] + slow(scores[j:], at + j)

    rng = np.random.default_rng(5)
    for _ in range(200):
        scores = [-toxicity.DRIFT] * 25
        hits = []
        for i in np.flatnonzero(rng.random(25) < 0.4).tolist():
            scores[i] = float(rng.normal())
            hits.append((i, scores[i]))
        found = sorted(toxicity.maximal_segments(hits))
        assert [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in slow(scores)]
        assert np.allclose([s for *_, s in found], [s for *_, s in slow(scores)])


# ---- near duplicates ------------------------------------------------------


def slow_simhash(text):
    words = WORD.findall(lowered(text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    """Least id reachable over links of at most 4 bits, from {id: fingerprint}."""
    least = dict(prints)
    ids = sorted(prints)
    least = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if least[j] < least[i] and (prints[i] ^ prints[j]).bit_count() <= 4:
                    least[i], changed = least[j], True
    return least


def test_simhash_query(spark, small, texts):
    prints = {i: slow_simhash(t) for i, t in texts.items()}
    expected = slow_components(prints)
    rows = queries.op8_simhash(spark, small).collect()
    assert len(rows) == len(texts)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {
        i: (f"{prints[i]:016x}", expected[i]) for i in texts
    }


@pytest.mark.parametrize("limit", [simhash.RUN_LIMIT, 3])
def test_simhash_links_are_complete(spark, limit):
    """Chains, dense groups and pairs at 4 and 5 bits; small limits send anchors to the block pass."""
    rng = np.random.default_rng(7)
    prints, value = [], int(rng.integers(0, 2**63))
    for _ in range(60):
        prints.append(value)
        for bit in rng.choice(64, rng.integers(1, 6), replace=False):
            value ^= 1 << int(bit)
    for _ in range(40):
        centre = int(rng.integers(0, 2**63))
        prints += [centre, centre ^ 0b1111, centre ^ (0b11111 << 40)]
    by_id = dict(enumerate(prints))
    signed = [(i, int(np.array([p], dtype=np.uint64).view(np.int64)[0])) for i, p in by_id.items()]
    groups = simhash.linked_groups(spark.createDataFrame(signed, "doc_id long, fp long"), limit)
    found = {r.fp: r.component_id for r in groups.collect()}
    assert {i: found[fp] for i, fp in signed} == slow_components(by_id)


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1001), (2000, 1000), (5, 7)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000, 2000: 1000}


# ---- language model -------------------------------------------------------


def test_language_model_query(spark, small, texts):
    tokens = lambda t: [*WORD.findall(lowered(t or "")), "<end>"]
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    counts = Counter(w for i, t in texts.items() if not held[i] for w in tokens(t))
    total, size = sum(counts.values()), len(counts)
    rows = queries.op9_katz_model(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = tokens(texts[r.doc_id])
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (size + 1))) for w in words)
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(words), total)
        assert r.n_known == sum(counts[w] > 0 for w in words)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    test = [r for r in rows if r.held_out]
    assert sum(r.score for r in test) > sum(r.base_score for r in test)


def test_katz_probabilities_equal_slow_model_and_add_up(spark):
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(30)]
    weights = 1 / np.arange(1, 31)
    train = [" ".join(rng.choice(vocabulary, 20, p=weights / weights.sum())) for _ in range(60)]
    model = language_model.fit(spark.createDataFrame([(t,) for t in train], "text string"))

    pairs, words, contexts = Counter(), Counter(), Counter()
    for t in train:
        tokens = [*t.split(), "<end>"]
        for before, word in zip(["<start>", *tokens], tokens, strict=False):
            pairs[before, word] += 1
            words[word] += 1
            contexts[before] += 1
    total = sum(words.values())

    def factors(found):
        n = Counter(found.values())
        return language_model.discounts(n)

    d2, d1 = factors(pairs), factors(words)
    off = lambda c, d: c * d[c - 1] if c <= 5 else float(c)
    mass = sum(off(c, d1) for c in words.values())
    unknown = max(1 - mass / total, 1 / (total + 1))

    def unigram(word):
        return (1 - unknown) * off(words[word], d1) / mass if words[word] else unknown

    def bigram(before, word):
        if not contexts[before]:
            return unigram(word)
        seen = {w: off(c, d2) for (b, w), c in pairs.items() if b == before}
        left = max(1 - sum(seen.values()) / contexts[before], 1 / (contexts[before] + 1))
        if word in seen:
            return (1 - left) * seen[word] / sum(seen.values())
        return left * unigram(word) / (1 - sum(unigram(w) for w in seen))

    for before in contexts:
        assert math.isclose(sum(bigram(before, w) for w in [*words, "never seen"]), 1)
    texts = [*train[:5], "w1 w2 nowhere w3", "nowhere nowhere", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in language_model.score(docs, model).collect():
        tokens = [*(texts[r.doc_id] or "").split(), "<end>"]
        expected = sum(math.log10(bigram(b, w)) for b, w in zip(["<start>", *tokens], tokens, strict=False))
        assert math.isclose(r.score, expected, rel_tol=1e-9), texts[r.doc_id]


# ---- pipeline -------------------------------------------------------------


def test_pipeline_packs_what_its_stages_keep(spark, small, texts):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small).cache()
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    assert len(kept["quality_classifier"]) < len(kept["language_id"]) <= len(texts)
    # Exact copies: the largest id stays; near copies: the least of each component.
    best = {}
    for i in kept["quality_classifier"]:
        best[texts[i]] = max(best.get(texts[i], i), i)
    assert kept["exact_dedup"] == set(best.values())
    least = slow_components({i: slow_simhash(texts[i]) for i in kept["exact_dedup"]})
    assert kept["simhash_dedup"] == set(least.values())
    packed = corpus_pipeline.run(spark, small).collect()
    assert check_packing(packed, {i: texts[i] for i in kept["simhash_dedup"]}) < 0.01


def test_packing_takes_added_tokens_as_the_library_does(spark):
    texts = {
        1: "end of text <|endoftext|> here", 2: "word<|endoftext|>word", 3: "<|startoftext|>", 4: "a <|ENDOFTEXT|> b",
        5: "x<|endoftext|><|startoftext|>, y's", 6: "<|endof text|>", 7: None, 8: "Ünder<|endoftext|>\n Über! " * 300,
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check_packing(packing.report(docs, public_tokenizers.path("word_bpe_49k.json")).collect(), texts)


def test_word_encoder_forgets_and_learns_again(monkeypatch, texts):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        definition = file.read()
    sample = [t for _, t in sorted(texts.items())]
    whole = packing.WordEncoder(definition).encode(sample)
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    small = packing.WordEncoder(definition)
    assert [small.encode([t])[0] for t in sample] == whole
    assert len(small.words.young) + len(small.words.old) < 20_000
