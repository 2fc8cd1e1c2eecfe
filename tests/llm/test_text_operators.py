"""Operators on texts against the libraries and brute force on the small table."""

import hashlib
import itertools
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from scopeforge.llm import crf_langid, imatch, quality_votes, signature_tree, substring_fm, token_files
from scopeforge.llm import sentencepiece_codec as codec
from scopeforge.llm.fm_index import earlier_spans
from scopeforge.llm.registry import QUERIES

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a", "a ", "▁", "▁a b▁", "a  b   c", "\n x", "é漢🙂\x00​<s>", "a<|endoftext|> b", "it's we'll  \n\n a", "a 　b"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_sentencepiece_equals_the_library(spark, sf_dir, texts):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for r in QUERIES["op1_sentencepiece"](spark, sf_dir).collect():
        ids = lib.encode(texts[r.doc_id], add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(" ".join(map(str, ids))))
        assert r.decoded_sha256 == sha(lib.decode(ids)) and r.bytes_covered == len(texts[r.doc_id].encode())


def test_pieces_spans_and_decoding_of_odd_texts(texts):
    lib, table = sentencepiece.SentencePieceProcessor(model_file=MODEL), codec.unit_table(MODEL)
    sample = ODD + list(texts.values())[:50]
    ids, begins, ends, n = codec.encode_texts(sample, table)
    at = 0
    for text, k in zip(sample, n.tolist()):
        own = ids[at:at + k].tolist()
        assert own == lib.encode(text)
        assert codec.decode_ids([*own, 2], table.model) == lib.decode([*own, 2])
        proto = lib.encode(text, return_type="proto").pieces
        if not any(table.model.kinds[i] == codec._BYTE for i in own):
            assert [(p.begin, p.end) for p in proto] == list(zip(begins[at:at + k].tolist(), ends[at:at + k].tolist()))
        assert not k or (begins[at] == 0 and ends[at + k - 1] == len(text.encode()))
        at += k


@pytest.mark.parametrize("ids", [[], [2], [0, 1, 300], [3 + 0xE6, 3 + 0xBC, 3 + 0xA2], [3 + 0xC3, 2, 3 + 0xA9], [3 + 0xC3, 300], [28705, 259, 500]])
def test_decoding_of_any_ids(ids):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert codec.decode_ids(ids, codec.unit_table(MODEL).model) == lib.decode(ids)


def compiled(mapping):
    """A character map in the compiled form: a double array with a block per trie node."""
    values, blob = {}, b""
    for k, v in mapping.items():
        values[k.encode()] = len(blob)
        blob += v.encode() + b"\0"
    prefixes = sorted({k[:i] for k in values for i in range(len(k) + 1)})
    block = {p: 256 * (i + 1) for i, p in enumerate(prefixes)}
    units = [0] * (256 * (len(prefixes) + 1))
    for p in prefixes:
        place = block[p[:-1]] + p[-1] if p else 0
        units[place] = (p[-1] if p else 0) | (p in values) << 8 | (place ^ block[p]) << 10
        if p in values:
            units[block[p]] = values[p] | 1 << 31
    return struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + blob


def test_longest_prefix_of_a_compiled_character_map():
    char_map = codec.CharacterMap(compiled({"ﬁ": "fi", "A": "a", "AB": "x", "é": "e"}))
    assert char_map.longest("ABC".encode(), 0) == (2, char_map.longest(b"AB", 0)[1])
    assert char_map.replacement(char_map.longest("ﬁ".encode(), 0)[1]) == b"fi"
    assert char_map.longest(b"zA", 0) == (0, 0) and char_map.longest(b"zA", 1)[0] == 1


def test_mapped_normalisation_keeps_source_spans():
    model = codec.Model(MODEL)
    model.map, model.squeeze = codec.CharacterMap(compiled({"ﬁ": "fi", "AB": "x"})), True
    form, begins, ends = model.normalise("  ﬁn  AB ")
    assert form == "▁fin▁x"
    spans = dict(zip(form.encode(), zip(begins.tolist(), ends.tolist())))
    assert spans[ord("f")] == spans[ord("i")] == (2, 5) and spans[ord("n")] == (5, 6) and spans[ord("x")] == (8, 10)


def test_token_files_hold_the_library_ids(spark, sf_dir, texts, tmp_path):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start = 0
    got = {r.doc_id: r for r in QUERIES["op2_token_files"](spark, sf_dir).collect()}
    for doc_id in sorted(texts):
        ids = np.array([*tok.encode(texts[doc_id], add_special_tokens=False).ids, 0], "<u4")
        r = got[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_files_are_sequences_and_masks(spark, sf_dir, tmp_path):
    import pyarrow as pa
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shards = token_files.write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}", sequence=64)
    for row in shards.collect():
        with pa.memory_map(f"{tmp_path}/{row['name']}") as source:
            whole = pa.ipc.open_file(source).read_all()
        assert whole.schema.field("ids").type == pa.list_(pa.uint16(), 64)
        assert sum(map(sum, whole["mask"].to_pylist())) == row.tokens and (whole.num_rows - 1) * 64 < row.tokens


def test_chunks_equal_whole_texts():
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    chunks = token_files.ChunkTable(public_tokenizers.path("byte_bpe_50k.json"), limit=20)
    ids, n = token_files.encode_documents(ODD, chunks)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [tok.encode(t, add_special_tokens=False).ids for t in ODD]


def test_chunks_of_random_characters_equal_whole_texts():
    import pyarrow as pa
    path, rng = public_tokenizers.path("byte_bpe_50k.json"), np.random.default_rng(3)
    tok, chunks = Tokenizer.from_file(path), token_files.ChunkTable(path, limit=500)
    signs = [*"aZéß×÷’”—.,'<| \t\n\r\x0b\x1c\x1f\0\x7f\x85\xa0\u1680\u180e\u2003\u2028\u200b\u202f\u205f\u3000、漢か🙂\u0301²½٣Жω9",
             " ", "\n", "'s", "'re", " 'll", "  ", "\n ", "<|endoftext|>"]
    for _ in range(20):
        texts = [None, *("".join(rng.choice(signs, rng.integers(0, 30))) for _ in range(300))]
        for column in (pa.array(texts), pa.array(texts, pa.large_string()).slice(7)):
            ids, n = token_files.encode_documents(column, chunks)
            for own, text in zip(np.split(ids, np.cumsum(n)[:-1]), column.to_pylist(), strict=True):
                assert own.tolist() == tok.encode(text or "", add_special_tokens=False).ids


def test_a_word_is_encoded_once_whatever_is_beside_it():
    chunks = token_files.ChunkTable(public_tokenizers.path("byte_bpe_50k.json"))
    words = ["".join(w) for w in itertools.product("aeé", "rst", "ioü", "nmx")]
    marks = [".", ",", "!", ";", ":", "?", ")", "...", ".\n", ",\n", "'s", "'ll"]
    token_files.encode_documents([" ".join(w + m for w in words) for m in marks], chunks)
    assert len(chunks.row) <= 2 * len(words) + 2 * len(marks) + 1
    alone = [w for w in chunks.row if w.removeprefix(" ").isalpha()]
    assert chunks.words(alone) == chunks.encode(alone)


def test_matching_statistics_against_brute_force():
    rng = np.random.default_rng(5)
    for window in (3, 5, 8):
        for _ in range(20):
            seqs = [rng.integers(1, 4, rng.integers(0, 20)).tolist() for _ in range(rng.integers(2, 12))]
            owners = rng.integers(0, 5, len(seqs))
            lengths = np.array([len(s) for s in seqs])
            if not lengths.sum():
                continue
            found = [set() for _ in seqs]
            for w, a, b in zip(*earlier_spans(np.array(sum(seqs, [])), lengths, owners, window)):
                found[w] |= set(range(a, b))
            for i, s in enumerate(seqs):
                want = set()
                for a in range(len(s) - window + 1):
                    part = s[a:a + window]
                    if any(owners[j] < owners[i] and any(t[k:k + window] == part for k in range(len(t)))
                           for j, t in enumerate(seqs)):
                        want |= set(range(a, a + window))
                assert found[i] == want


def repeated(texts, window=50):
    words = {d: WORDS.findall(t) for d, t in texts.items()}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i:i + window]), d)
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < d:
                gone |= set(range(i, i + window))
        yield d, (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.mark.parametrize("hot", [8000, 2])
def test_substrings_against_brute_force(spark, sf_dir, texts, hot):
    got = substring_fm.deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"), 20, hot)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()} == dict(repeated(texts))


def test_quality_counts_and_verdicts(spark, sf_dir, texts):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    right = total = 0
    for r in QUERIES["op5_quality_votes"](spark, sf_dir).collect():
        text, words = texts[r.doc_id], WORDS.findall(texts[r.doc_id])
        lines = [x for x in text.split("\n") if WORDS.search(x)]
        at = {}
        for i in range(len(words) - 7):
            at.setdefault(tuple(words[i:i + 8]), []).append(i)
        twice = {k for v in at.values() if len(v) > 1 for i in v for k in range(i, i + 8)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(twice))
        assert r.base_failed == (len(words) < 20 or 100 * len(twice) > 30 * len(words)) and not (r.base_failed and r.kept)
        if r.doc_id in labels and not r.base_failed:
            right, total = right + (r.kept == bool(labels[r.doc_id])), total + 1
    assert right >= 0.95 * total


def test_estimate_finds_planted_accuracies():
    rng = np.random.default_rng(3)
    good = rng.random(20_000) < 0.7
    votes = np.stack([np.where(rng.random(20_000) < 0.2, 0, np.where(good, 1, np.where(rng.random(20_000) < p, -1, 1)))
                      for p in (0.9, 0.8, 0.6, 0.5)], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, table = quality_votes.estimate(patterns, counts.astype(float))
    assert abs(prior - 0.7) < 0.03 and abs(table[0, 0, 0] - 0.72) < 0.05


def test_language_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = QUERIES["op6_crf_language"](spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)


def test_code_switched_words_are_told_apart():
    rng = np.random.default_rng(1)
    say = {"aa": ["baba", "mama", "kaka", "tata"], "oo": ["bobo", "momo", "koko", "toto"]}
    samples = [(k, " ".join(rng.choice(v, 60))) for k, v in say.items() for _ in range(30)]
    labeller = crf_langid.Labeller(crf_langid.fit(samples))
    _, _, post = labeller.words(["baba mama kaka tata bobo momo koko toto"])
    assert [labeller.chain.languages[k] for k in post.argmax(1)] == ["aa"] * 4 + ["oo"] * 4
    assert labeller.documents(["12 ##", ""]) [0] == ["und", "und"]


def test_transitions_follow_the_likelihood():
    """Expected moves against finite differences of the log-likelihood, summed over all paths."""
    import itertools
    rng = np.random.default_rng(3)
    chain = crf_langid.Chain(["a", "b", "c"], {})
    chain.start, chain.move = rng.normal(size=3), rng.normal(size=(3, 3))
    lengths = np.array([6, 1, 4])
    scores = rng.normal(size=(11, 3)) * 2
    gold = rng.integers(0, 3, 11)

    def likelihood():
        total = 0.0
        for begin, n in zip(np.cumsum(lengths) - lengths, lengths):
            def path(p):
                return chain.start[p[0]] + sum(scores[begin + i, k] for i, k in enumerate(p)) + sum(
                    chain.move[x, y] for x, y in zip(p, p[1:]))
            total += path(gold[begin:begin + n]) - np.log(sum(np.exp(path(p)) for p in itertools.product(range(3), repeat=int(n))))
        return total

    ahead, back, heat = chain.passes(scores, lengths)
    expected = chain.expected_moves(ahead, back, heat, lengths)
    seen = np.zeros((3, 3))
    for begin, n in zip(np.cumsum(lengths) - lengths, lengths):
        np.add.at(seen, (gold[begin:begin + n - 1], gold[begin + 1:begin + n]), 1)
    for x in range(3):
        for y in range(3):
            value = chain.move[x, y]
            chain.move[x, y] = value + 1e-5
            up = likelihood()
            chain.move[x, y] = value - 1e-5
            slope = (up - likelihood()) / 2e-5
            chain.move[x, y] = value
            assert abs(slope - (seen - expected)[x, y]) < 1e-6


def test_every_language_is_learned(spark, monkeypatch):
    """More languages than the sample has room for at the usual size: none is left out."""
    monkeypatch.setattr(crf_langid, "SAMPLE_ROWS", 60)
    monkeypatch.setattr(crf_langid, "WEIGHTS", 1 << 18)
    monkeypatch.setattr(crf_langid, "LEAST_PER_LANGUAGE", 4)
    rows = [(1000 * k + i, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + (i * j) % 26)}x" for j in range(30)), f"l{k:02}")
            for k in range(70) for i in range(12 if k else 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = crf_langid.training_rows(docs)
    assert len({lang for lang, _ in sample}) == 70 and len(sample) <= 70 * 4
    chain = crf_langid.fit(sample)
    assert len(chain.languages) == 70 and chain.weights.size <= 1 << 19
    got = crf_langid.predict(docs, chain, ["doc_id", "lang"]).collect()
    assert sum(r.lang == r.lang_pred for r in got) > 0.9 * len(got)


def test_posteriors_against_enumeration():
    from itertools import product
    rng = np.random.default_rng(2)
    chain = crf_langid.Chain(["a", "b", "c"], {})
    chain.start, chain.move = rng.normal(size=3), rng.normal(size=(3, 3))
    lengths = np.array([4, 1, 3])
    scores = rng.normal(size=(8, 3))
    got, at = chain.posteriors(scores, lengths), 0
    for n in lengths:
        want = np.zeros((n, 3))
        for path in product(range(3), repeat=int(n)):
            weight = np.exp(chain.start[path[0]] + sum(scores[at + t, k] for t, k in enumerate(path))
                            + sum(chain.move[i, j] for i, j in zip(path, path[1:])))
            for t, k in enumerate(path):
                want[t, k] += weight
        assert np.allclose(got[at:at + n], want / want.sum(1, keepdims=True))
        at += n


def test_imatch_fingerprints_against_plain_python(spark, sf_dir, texts):
    """Lexicon, subsets, fingerprints and likeness of texts, edited and next texts, term by term."""
    from scopeforge.llm.common import mix, span_hashes
    whole = (1 << 64) - 1
    mix_ = lambda x: int(mix(np.array([x & whole], np.uint64))[0])

    def terms(text):
        words = set(re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text)))
        return {int(span_hashes(np.frombuffer(b := w.encode(), np.uint8), np.array([0]), np.array([len(b)]))[0]) >> 16 for w in words}

    of = {i: terms(t) for i, t in texts.items()}
    df = {}
    for own in of.values():
        for t in own:
            df[t] = df.get(t, 0) + 1
    lex = {t for t, n in df.items() if n > 1 and imatch.LOW * len(texts) <= n <= imatch.HIGH * len(texts)}

    def fingerprint(text):
        own = terms(text)
        held = own & lex
        if not held:
            total = sum(mix_(t + 0x14057B7EF767814F) for t in own)
            return [mix_(total + k) >> 32 for k in range(1, len(imatch.RATES) + 1)]
        out = []
        for k, rate in enumerate(imatch.RATES):
            kept = [t for t in held if mix_(t + k * 0x9E3779B97F4A7C15) < int(rate * 2.0 ** 64)]
            total = sum(mix_(t + 0x5851F42D4C957F2D) for t in kept) & whole
            out.append(mix_(total) >> 32 if total else 0)
        return out

    def near(a, b):
        filled = [(x, y) for x, y in zip(a, b) if x or y]
        return sum(x == y for x, y in filled) / len(filled) if filled else 1.0

    got = {r.doc_id: r for r in QUERIES["op7_imatch"](spark, sf_dir).collect()}
    ids = sorted(texts, reverse=True)
    for at in range(0, len(ids), 4):
        i, j = ids[at], ids[(at + 1) % len(ids)]
        k = len(texts[i])
        edited = texts[i][:k - k // 2] + texts[j][:k // 2]
        a, e, n = fingerprint(texts[i]), fingerprint(edited), fingerprint(texts[j])
        assert got[i].fingerprint == "".join(f"{x:08x}" for x in a)
        assert got[i].edited_fingerprint == "".join(f"{x:08x}" for x in e)
        assert abs(got[i].near_edited - near(a, e)) < 1e-12 and abs(got[i].near_next - near(a, n)) < 1e-12


def test_imatch_edits_and_likeness(spark, sf_dir, texts):
    got = {r.doc_id: r for r in QUERIES["op7_imatch"](spark, sf_dir).collect()}
    order = sorted(texts, reverse=True)
    prints = {}
    for i, d in enumerate(order):
        text, after = texts[d], order[(i + 1) % len(order)]
        half = len(text) // 2
        edited = text[:len(text) - half] + texts[after][:half]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(text), sha(edited))
        assert (got[d].near_next == 1) == (got[d].fingerprint == got[after].fingerprint)
        prints.setdefault(text, set()).add(got[d].fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    near = [got[d].near_edited > got[d].near_next for d in order if len(texts[d]) > 400]
    assert np.mean(near) > 0.8


def test_lexicon_stays_in_the_band(spark, sf_dir, texts):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for t in texts.values():
        for w in set(WORDS.findall(t.translate({i: i + 32 for i in range(65, 91)}))):
            seen[w] = seen.get(w, 0) + 1
    n = len(texts)
    assert len(imatch.lexicon(docs)) == sum(1 for v in seen.values() if v > 1 and imatch.LOW * n <= v <= imatch.HIGH * n)


def components(texts, k, percent):
    lower = {i: i + 32 for i in range(65, 91)}
    sets = {}
    for d, t in texts.items():
        w = WORDS.findall(t.translate(lower))
        sets[d] = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    label = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {d: low if v == high else v for d, v in label.items()}
    return {d: (len(sets[d]), label[d]) for d in sets}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_near_duplicates_against_all_pairs(spark, sf_dir, texts, k, percent):
    got = signature_tree.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k, percent / 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == components(texts, k, percent)


def test_groups_in_blocks_with_long_texts(spark, monkeypatch):
    """One large group of near copies of long texts, a passage that many others share, and
    blocks far smaller than both: the same components as by all pairs."""
    monkeypatch.setattr(signature_tree, "BLOCK_NODES", 7)
    monkeypatch.setattr(signature_tree, "BLOCK_BYTES", 4096)
    monkeypatch.setattr(signature_tree, "BLOCK_SHINGLES", 5000)
    rng = np.random.default_rng(8)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10 ** 9, n)]
    base, passage, rows = word(1500), word(60), {}
    for i in range(40):
        own = list(base)
        for at in rng.integers(0, 1500, int(rng.integers(1, 25))):
            own[at] = f"x{i}"
        rows[i] = " ".join(own)
    for i in range(40, 110):
        at = int(rng.integers(0, 90))
        own = word(int(rng.integers(100, 400)))
        rows[i] = " ".join(own[:at] + passage + own[at:])
    for i in range(110, 150):
        rows[i] = " ".join(word(int(rng.integers(1, 12))))
        rows[i + 100] = rows[i] + " tail"
    got = signature_tree.near_duplicates(spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3), 5, 0.8)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()}
    assert got == components(rows, 5, 80)
    assert len({got[i][1] for i in range(40)}) < 20 < len({got[i][1] for i in range(40, 110)})


def test_bitmaps_fold_and_bound_the_overlap():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64)) for n in (3, 40, 700, 900)]
    sets.append(np.unique(np.concatenate([sets[2][:650], sets[3][:30]])))
    gram, size = np.concatenate(sets), np.array([len(s) for s in sets])
    power = signature_tree.bit_powers(size)
    flags, words = signature_tree.bitmaps(gram, size, power)
    first = np.cumsum(words) - words
    fold = lambda i, w: np.bitwise_or.reduce(flags[first[i]:first[i] + words[i]].reshape(-1, w), axis=0)
    for i in range(5):
        for j in range(i):
            w = min(words[i], words[j])
            x, y = fold(i, w), fold(j, w)
            assert (x == signature_tree.bitmaps(sets[i], size[i:i + 1], np.array([int(w).bit_length() + 5]))[0]).all()
            lost = min(size[k] - int(np.bitwise_count(f).sum()) for k, f in ((i, x), (j, y)))
            assert len(np.intersect1d(sets[i], sets[j])) <= int(np.bitwise_count(x & y).sum()) + lost


def test_signature_trees_against_all_pairs(monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 62, 120).astype(np.uint64)
    sets = []
    for _ in range(90):
        keep = base[rng.random(120) > rng.choice([0.02, 0.06, 0.3])]
        sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 62, rng.integers(0, 12)).astype(np.uint64)])))
    size, gram = np.array([len(s) for s in sets]), np.concatenate(sets)
    block = np.arange(90) % 2
    for own in (None, block):
        label = list(range(90))
        for i in range(90):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if (own is None or own[i] != own[j]) and 100 * both >= 90 * (size[i] + size[j] - both):
                    low, high = sorted((label[i], label[j]))
                    label = [low if x == high else x for x in label]
        assert signature_tree.join_group(gram, size, own, 0.9).tolist() == label


def test_linked_sets_share_a_part_key():
    rng = np.random.default_rng(6)
    for similarity in (0.9, 0.8):
        for n in (1, 2, 3, 5, 9, 10, 11, 19, 20, 40, 100, 300):
            for _ in range(30):
                a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
                drop = rng.integers(0, int(n * (1 - similarity)) + 1)
                b = a[drop:]
                add = rng.integers(0, int(n * (1 - similarity)) + 1)
                b = np.unique(np.concatenate([b, rng.integers(0, 1 << 62, add).astype(np.uint64)]))
                if len(np.intersect1d(a, b)) < similarity * len(np.union1d(a, b)):
                    continue
                key, count = signature_tree.part_keys(np.concatenate([a, b]), np.array([len(a), len(b)]), similarity)
                assert set(key[:count[0]].tolist()) & set(key[count[0]:].tolist())


def test_unrelated_sets_share_no_part_key():
    """Sets with elements in few parts have no key in common but by an element."""
    rng = np.random.default_rng(7)
    size = rng.integers(5, 100, 4000)
    gram = np.concatenate([np.unique(rng.integers(0, 1 << 62, n)).astype(np.uint64) for n in size])
    key, count = signature_tree.part_keys(gram, size, 0.8)
    who = np.repeat(np.arange(len(size)), count)
    pairs = np.unique(np.stack([key, who.astype(np.uint64)], 1), axis=0)
    assert len(np.unique(pairs[:, 0])) == len(pairs)


def test_a_worker_remembers_the_tables_of_one_stage():
    from scopeforge.llm import common
    table = codec.unit_table(MODEL)
    assert codec.unit_table(MODEL) is table
    chain = crf_langid.Chain(["a", "b"], {})
    assert crf_langid.labeller_of(chain) is crf_langid.labeller_of(chain)
    assert len(common._REMEMBERED) == 1 and codec.unit_table(MODEL) is not table


def test_labelling_a_slice_takes_a_bounded_multiple_of_its_bytes():
    """Strings of the words and spare copies of the chains' values are gone before the largest arrays are made."""
    import tracemalloc
    labeller = crf_langid.Labeller(crf_langid.Chain(["a", "b", "c", "d"], {}))
    texts = [" ".join(f"w{(i * j) % 997}" for i in range(700)) for j in range(300)]
    labeller.documents(texts)
    tracemalloc.start()
    labeller.documents(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 * sum(map(len, texts))
