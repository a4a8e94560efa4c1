"""Each operator against brute force on small inputs, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import decontam, line_dedup, line_quality, main_text, pii, piece_codec, queries, simhash, site_quality, token_store, warc
from tidemark.llm.common import connected_components, scratch

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
ODD = [(None, None), (901, None), (902, ""), (903, " \n\t "), (904, "x"), (905, "é̃ \U0001f600 ß\x0b\x85 end"), (905, "é̃ \U0001f600 ß\x0b\x85 end"), (906, "Word " * 30_000)]


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(f"{WORDS[a]}{WORDS[b]}" for a, b in rng.integers(0, len(WORDS), (n, 2)))


def frame(spark, rows):
    """Documents with columns whose names could clash with inner ones."""
    return spark.createDataFrame([(i, t, "fp", "kept", "h") for i, t in rows], "doc_id long, text string, fp string, kept string, h string").repartition(3)


def empty(spark):
    return frame(spark, []).limit(0)


# 1
def brute_fingerprint(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark):
    rows = ODD[:-1] + [(k, prose(k // 3, 80) + (f" end{k}" if k % 3 else "")) for k in range(60)] + [(500 + k, prose(7, 200).replace(" ", "  ", 1) + f" v{k}") for k in range(40)]
    out = simhash.near_duplicates(frame(spark, rows), 4, 4).collect()
    assert len(out) == len(rows)
    prints = [brute_fingerprint(t, 4) for _, t in rows]
    assert Counter((r["doc_id"], r["fingerprint"]) for r in out) == Counter((i, f"{p:016x}") for (i, _), p in zip(rows, prints))
    label = list(range(len(rows)))
    for _ in rows:
        label = [min(label[j] for j in range(len(rows)) if (prints[i] ^ prints[j]).bit_count() <= 4) for i in range(len(rows))]
    low = {c: min((rows[i][0] for i in range(len(rows)) if label[i] == c and rows[i][0] is not None), default=None) for c in set(label)}
    assert Counter((r["doc_id"], r["component_id"]) for r in out) == Counter((rows[i][0], low[label[i]]) for i in range(len(rows)))
    assert simhash.near_duplicates(empty(spark), 4, 4).count() == 0
    kept = simhash.keep_first(frame(spark, rows), 4, 4)
    assert kept.columns == ["doc_id", "text", "fp", "kept", "h"] and kept.count() == kept.select("doc_id").distinct().count()


@pytest.mark.parametrize("rows", [1 << 18, 20])
def test_ball_hashing_in_small_blocks(spark, monkeypatch, rows):
    """Blocks that are cut within a task, and before the shuffle, give the components of brute force."""
    monkeypatch.setattr(simhash, "BLOCK_VARIANTS", 3_000)
    monkeypatch.setattr(simhash, "BLOCK_ROWS", rows)
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, 4, dtype=np.uint64)
    fps = np.unique(np.concatenate([c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (3, 60), dtype=np.uint64), axis=0) for c in centre]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    comp = {r["node"]: r["root"] for r in connected_components(simhash.links(df, len(fps), 4)).collect()}
    label = np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    for _ in fps:
        label = np.array([label[n].min() for n in near])
    got = [comp.get(int(x), int(x)) for x in fps.view(np.int64)]
    assert len(set(zip(got, label.tolist()))) == len(set(got)) == len(set(label.tolist()))


def edited(k, n):
    """A text of 200 words with ``n`` words replaced, far enough apart that each takes five shingles."""
    words = prose(4_000 + k, 200).split()
    for j in range(n):
        words[10 + j * 15] = f"edit{k}x{j}"
    return " ".join(words)


def test_similar_texts_are_one_group(spark):
    """Groups by brute force over all pairs' shingle sets, also of many texts at once."""
    rows = ODD[:-1] + [(k, edited(k, 0)) for k in range(30)] + [(100 + k, edited(k, k % 10)) for k in range(30)]
    rows += [(200 + k, edited(99, 2).replace("edit99x0", f"own{k}")) for k in range(90)]
    sets = [set(zip(*[(w := (t or "").lower().split())[i:] for i in range(5)])) or {tuple(w)} - {()} for _, t in rows]
    alike = [[a == b or bool(x | y) and len(x & y) >= 0.8 * len(x | y) or not (x | y) for b, y in enumerate(sets)] for a, x in enumerate(sets)]
    label = list(range(len(rows)))
    for _ in range(8):
        label = [min(label[j] for j in range(len(rows)) if alike[i][j]) for i in range(len(rows))]
    assert 60 > len(set(label)) - len(ODD) > 30
    kept = simhash.keep_first(frame(spark, rows), 5, 4, 80)
    want = {min((rows[i][0] for i in range(len(rows)) if label[i] == c and rows[i][0] is not None), default=None) for c in set(label)}
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(want)
    assert simhash.keep_first(empty(spark), 5, 4, 80).count() == 0


# 2
def test_decontamination(spark):
    items = [(k, prose(1000 + k, 15 + 4 * k)) for k in range(12)] + [(50, prose(77, 150)), (None, "short one"), (51, ""), (52, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(k, prose(k, 150)) for k in range(40)]
    words = lambda k: items[k][1].split()
    leaks = {(100 + k, k): prose(200 + k, 40 + k) + " " + items[k][1].upper() + ". " + prose(300 + k, 50) for k in range(12)}
    changed = words(8)
    changed[3], changed[20] = "replaced", "other"
    leaks |= {(200, 8): prose(5, 90) + " " + " ".join(changed), (201, 50): prose(6, 30) + " " + items[12][1] + " " + prose(8, 10)}
    rows = ODD + docs + [(i, t) for (i, _), t in leaks.items()]
    found = decontam.find_leaks(frame(spark, rows), bench)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == set(leaks)
    blocks = decontam.find_leaks(frame(spark, rows), bench, block_items=5)
    assert {(r["doc_id"], r["item_id"]) for r in blocks.collect()} == set(leaks)
    assert decontam.find_leaks(empty(spark), bench).count() == 0 and decontam.find_leaks(frame(spark, rows), bench.limit(0)).count() == 0


def test_leaks_with_null_and_repeated_ids_go(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(k, prose(1000 + k, 40)) for k in range(3)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    leak = f"{prose(1, 30)} {prose(1001, 40)}"
    rows = [(None, leak), (None, prose(2, 50)), (7, leak), (7, prose(3, 50)), (8, None)] + [(20 + k, prose(30 + k, 50)) for k in range(10)]
    left = corpus_pipeline.benchmark_decontamination(spark, frame(spark, rows), str(tmp_path))
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter(x for x in rows if x[1] != leak)


@pytest.mark.parametrize("others", [0, 40, 2])
def test_widespread_leaks_are_found(spark, others):
    """A document alone in its table, a leak copied into a third of the rows, and one in nearly all of them."""
    bench = spark.createDataFrame([(k, prose(1000 + k, 40)) for k in range(5)], "item_id long, text string")
    hot = [(500 + k, f"{prose(600 + k, 20)} {prose(1002, 40)} {prose(700 + k, 20)}") for k in range(20 if others else 1)]
    found = decontam.find_leaks(frame(spark, hot + [(k, prose(k, 80)) for k in range(others)]), bench)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(i, 2) for i, _ in hot}


def paraphrase(words: list[str], rng, swapped: float, added: float) -> list[str]:
    out = []
    for w in words:
        out.append(w if rng.random() >= swapped else f"other{rng.integers(1_000_000)}")
        out += [f"more{rng.integers(1_000_000)}"] * (rng.random() < added)
    return out


def brute_leaks(rows, items, cover=0.8, partial=0.6, answer=0.75):
    """All items against all windows of all texts by the table of the longest common subsequence, without any search."""

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    found = set()
    for doc_id, text in rows:
        words = (text or "").lower().split()
        for item_id, item in items:
            want, last = item.split(), decontam.answer_of(item)
            step = max(len(want) // 2, 1)
            for at in range(0, len(words), step):
                window = words[at : at + 2 * len(want) + step]
                share = common(window, want) / len(want)
                if share >= cover or share >= partial and common(window, last) / len(last) >= answer:
                    found.add((doc_id, item_id))
                    break
    return found


def test_paraphrases_against_brute_force(spark):
    """At least nine tenths of what brute force finds, nothing else, and every one with all its words."""
    rng = np.random.default_rng(0)
    items = [(k, prose(5_000 + k, 20 + k)) for k in range(20)]
    ways = [(0, 0), (0.1, 0), (0.15, 0.3), (0, 0.8), (0.3, 0), (0.5, 0)]
    rows = [(100 * k + j, " ".join([prose(6_000 + k, 30), *paraphrase(items[k][1].split(), rng, *way), prose(7_000 + k + j, 30)])) for k in range(20) for j, way in enumerate(ways)]
    rows += [(9_000 + k, prose(8_000 + k, 120)) for k in range(40)] + [(9_100, rows[0][1]), (9_100, rows[0][1]), (None, rows[1][1])]
    want = brute_leaks(rows, items)
    found = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found <= want and len(found) >= 0.9 * len(want)
    whole = {(100 * k + j, k) for k in range(20) for j in (0, 3)}
    assert whole <= want and whole <= found and not any(i is not None and i >= 9_000 and i != 9_100 for i, _ in found)


@pytest.mark.parametrize("others", [0, 200])
def test_an_item_in_every_document(spark, others):
    """Also where its words are in all passages, and where a sixth of the documents hold it."""
    items = [(k, prose(1000 + k, 24)) for k in range(3)]
    hot = [(k, items[1][1] if k % 2 else f"{prose(k, 8)} {items[1][1]}") for k in range(40)]
    found = decontam.find_leaks(frame(spark, hot + [(1_000 + k, prose(100 + k, 50)) for k in range(others)]), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(k, 1) for k in range(40)}


def test_common_subsequence():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = (rng.integers(0, 6, rng.integers(1, 30)).tolist() for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert decontam.common_length(a, decontam.masks_of(b)) == table[-1, -1]


# 3
MODEL = queries.PIECES


def test_sentencepiece(spark):
    rows = ODD + [(1, "  two  spaces at ends "), (2, "a\n\nb\tc"), (3, "日本語 ▁ 12345 ñandú"), (4, "<s> </s> <0x41>"), (5, prose(1, 300))]
    out = piece_codec.encode(frame(spark, rows), MODEL)
    original = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = [(i, tuple(original.encode(t or ""))) for i, t in rows]
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in out.collect()) == Counter(want)
    assert Counter((r["doc_id"], r["text"]) for r in piece_codec.decode(out, MODEL).collect()) == Counter((i, (t or "").replace("▁", " ")) for i, t in rows)
    report = piece_codec.round_trip(frame(spark, rows), MODEL).collect()
    assert all(r["decoded"] for r in report) and sum(r["differing"] for r in report) == 0
    assert piece_codec.encode(empty(spark), MODEL).count() == 0


def test_unigram_model(tmp_path):
    """A unigram model written by hand: the rebuilt tokenizer gives the original library's ids."""
    proto = piece_codec.sentencepiece_model_pb2.ModelProto()
    for piece, score, kind in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)] + [(f"<0x{b:02X}>", 0, 6) for b in range(256)] + [(p, -float(k + 1), 1) for k, p in enumerate(["▁", "▁al", "pha", "▁alpha", "a", "l", "p", "h", "▁be", "ta", "b", "e", "t"])]:
        proto.pieces.add(piece=piece, score=score, type=kind)
    proto.trainer_spec.model_type, proto.trainer_spec.byte_fallback, proto.trainer_spec.unk_id = 1, True, 0
    proto.normalizer_spec.add_dummy_prefix, proto.normalizer_spec.remove_extra_whitespaces, proto.normalizer_spec.name = True, False, "identity"
    path = tmp_path / "u.model"
    path.write_bytes(proto.SerializeToString())
    codec = piece_codec.Codec(str(path))
    texts = ["alpha beta", "alphab é", "  ta", "", "pal "]
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)] == [codec.original.encode(t) for t in texts] and codec.differing == 0
    assert codec.texts_of([np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)]) == texts


def test_parity_is_counted_and_ids_are_the_rebuilt_tokenizers():
    """Where the original library gives other ids, the result stays and the difference is counted."""
    codec = piece_codec.Codec(queries.PIECES)

    class Other:
        def encode(self, texts, num_threads=1):
            return [[1, 2, 3] for _ in texts]

    want = codec.encode(["alpha beta"])
    codec = piece_codec.Codec(queries.PIECES)
    codec.original = Other()
    assert codec.encode(["alpha beta"]) == want and codec.differing == 2 and not codec.lost


# 4
def brute_rules(text):
    text = text or ""
    words, seen, dups = re.findall("[^\x20\x09-\x0d]+", text), set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dups += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count, cover = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            cover |= set(range(i, i + 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(cover)


def test_quality_rules(spark):
    good = [(k, "\n".join(prose(9 * k + j, 12).capitalize() + "." for j in range(4))) for k in range(60)]
    bad = [(100 + k, "\n".join(" ".join(f"{w}{'#$%&*'[k % 5] * 3}" for w in prose(k + j, 12).split()) for j in range(4))) for k in range(60)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good[:40]] + [(i, 0, 0) for i, _ in bad[:40]] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    rows = ODD + good + bad + [(300, " ".join("abcdefgh") + " x " + " ".join("abcdefgh"))]
    docs = frame(spark, rows)
    out = line_quality.quality_rules(docs, line_quality.fit(docs, labels)).collect()
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter((r["doc_id"], *(r[f] for f in fields)) for r in out) == Counter((i, *brute_rules(t)) for i, t in rows)
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in out)
    kept = {r["doc_id"] for r in out if r["kept"]}
    assert {i for i, _ in good[40:]} <= kept and not kept & {i for i, _ in bad[40:]}
    assert line_quality.fit(docs, labels.limit(0)) is None
    assert line_quality.quality_rules(docs, None).where("kept").count() == 120 and line_quality.quality_rules(empty(spark), None).count() == 0


def test_lines_are_labelled_one_by_one(spark):
    """Labels change within documents: held-out line accuracy on pages and documents, and documents of both kinds of line."""
    folder = "/root/testdata/sf0.01"
    docs, labels, pages = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels", "pages"))
    sequences = line_quality.sequences_of(docs, labels, pages)
    rest, held_out = [s for k, s in enumerate(sequences) if k % 5], sequences[::5]
    assert 0.2 < np.mean([len(set(y.tolist())) > 1 for x, y in held_out])
    crf = line_quality.train(rest)
    assert line_quality.accuracy(crf, held_out) > 0.9
    clean = docs.join(labels.where("quality = 1 and toxic = 0"), "doc_id").where("lang = 'en'").orderBy("doc_id").limit(40).collect()
    lines = [x for r in clean for x in r["text"].split("\n") if 8 <= len(x.split()) <= 40 and x.isascii() and x.endswith(".")][:60]
    menu = ["Home", "About us", "Login", "Imprint", "Menu", "Next"]
    junk = [" ".join(f"{w}{'#$%&*'[k % 5] * 3}" for w in x.split()) for k, x in enumerate(lines)]
    mixed = ["\n".join([*lines[k : k + 3], *menu, *lines[k + 3 : k + 6]]) for k in range(0, 54, 6)]
    spoilt = ["\n".join([lines[k], *junk[k + 1 : k + 6]]) for k in range(0, 54, 6)]
    found = np.array([crf.viterbi(line_quality.read_text(t).lines) for t in mixed])
    assert found[:, [0, 1, 2, -3, -2, -1]].mean() > 0.9 and found[:, 3:9].mean() < 0.1
    out = {r["doc_id"]: r["kept"] for r in line_quality.quality_rules(frame(spark, [*enumerate(mixed + spoilt)]), crf).collect()}
    assert out == {k: k < len(mixed) for k in range(len(mixed + spoilt))}


def test_page_lines():
    text, labels = line_quality.page_lines(PAGE.format(open="<article>", close="</article>"))
    inside = [line for line, label in zip(text.split("\n"), labels) if label]
    assert inside == ["Title & more", "First boldness of the article, and <tags>.", "Second part", "goes on.", "Third."] and "Home page" in text
    assert line_quality.page_lines("<p>no article") is None


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    crf = line_quality.Crf(rng.normal(size=(len(line_quality.FEATURES), 2)), rng.normal(size=(2, 2)))
    for n in (1, 2, 7):
        x = rng.normal(size=(n, len(line_quality.FEATURES)))
        score = lambda p: sum((x @ crf.emit)[t, y] for t, y in enumerate(p)) + sum(crf.move[a, b] for a, b in zip(p, p[1:]))
        best = max((tuple(k >> t & 1 for t in range(n)) for k in range(1 << n)), key=score)
        assert tuple(crf.viterbi(x)) == best


# 5
def test_warc(spark):
    evil = "x WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 99999999\r\n\r\n"
    rows = [(k, f"http://a/{k} \r\nb", evil * (k % 50) if k % 3 else None) for k in range(400)] + [(7, "u", "same"), (7, "u", "same"), (9, None, "same"), (None, "v", "same"), (None, "v", "alone\0é")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    files = warc.write_archives(pages.repartition(3), scratch(spark, "warc"), file_bytes=20_000)
    assert files.count() > 3
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = Counter()
    for i, _, h in rows:
        raw, one = (h or "").encode(), first.get(h or "")
        kind = "response" if one is None or i == one else "revisit"
        want[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), kind, None if kind == "response" else one] += 1
    for block in (4_096, 1 << 20):
        assert Counter(map(tuple, warc.read_archives(files, block).collect())) == want
    assert warc.round_trip(pages.limit(0)).count() == 0
    broken = files.withColumn("size", F.col("size") - 1)
    with pytest.raises(ValueError):
        warc.read_archives(broken).count()


# 6
def near(a, b):
    a, b = sorted((a.split(" "), b.split(" ")), key=len, reverse=True)
    i = next((k for k in range(len(b)) if a[k] != b[k]), len(b))
    return len(a) - len(b) <= 1 and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i + 1 :] == b[i:])


def test_line_dedup(spark):
    base = [(k, "\n".join(prose(3 * k + j, 4 + 3 * j) for j in range(5))) for k in range(25)]
    rows = [(904, "x"), (905, "a b c d e f\nA  b c d e\tf\nshort\nshort")] + base
    rows += [(100 + k, "\n".join(line.upper() if k % 3 else " ".join(w for j, w in enumerate(line.split()) if j != k % 5) for line in base[k][1].split("\n"))) for k in range(20)]
    rows += [(200 + k, f"one two three four five six seven eight nine {k} ten eleven") for k in range(30)]
    seen, out = [], {}
    for i, t in sorted(rows):
        keep = []
        for line in t.split("\n"):
            x = re.sub("[ \t-\r]+", " ", line).lower().strip(" ")
            n = len(x.split(" "))
            gone = n >= 5 and (x in seen or n >= 8 and any(near(x, y) for y in seen if len(y.split(" ")) >= 8))
            if n >= 5 and x not in seen:
                seen.append(x)
            if not gone:
                keep.append(line)
        out[i] = "\n".join(keep)
    docs = frame(spark, rows + [(None, None), (901, None), (902, "")])
    done = line_dedup.dedup_lines(docs)
    assert done.columns == [*docs.columns, "tidemark_lines"]
    got = {r["doc_id"]: r["text"] for r in done.collect()}
    assert got == out | {None: None, 901: None, 902: ""}
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_short_lines_are_deduplicated(spark, tmp_path):
    import corpus_pipeline

    rows = [(1, "read more\n\none two three four five\nHome\n"), (2, "Read  More\n\none two other four five\nhome\nnew line"), (3, "one two three four\none two three four five six\nread more")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {1: rows[0][1], 2: "\nnew line", 3: "one two three four"}
    assert {r["doc_id"]: r["text"] for r in queries.op6_line_dedup(spark, str(tmp_path)).collect()} == want
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.line_deduplication(spark, docs, "").collect()} == want


# 7
KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def brute_spans(text):
    out = []
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (16 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii(spark):
    texts = [
        "a@b.c_d@e.f x..y@z", "1.2.3.4.5.6.7.8 256.1.1.1 000.001.02.255 1.2.3", "4111 1111-1111 1111 4111111111111112 41111111111111111234", "+1 (415) 555-0100 +1 2 +123456789012345678 ++49 (0)30 1234567 ", "é\U0001f600 me@x.org é 10.0.0.1",
        "a" * 50_000 + "@", "9" * 50_000, "@@@ +", "contact: jo.e+tag@mail.example.com, card 4539 1488 0343 6467.",
    ]
    rows = ODD + list(enumerate(texts))
    out = pii.find_pii(frame(spark, rows))
    got = Counter((r["doc_id"], r["base_sha256"], r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"]) for r in out.collect())
    assert got == Counter((i, hashlib.sha256(",".join(brute_spans(t)).encode()).hexdigest(), len(brute_spans(t))) for i, t in rows)
    assert pii.find_pii(empty(spark)).count() == 0


def test_pii_learns_contexts(spark):
    rows = [(k, f"{prose(k, 6)} please reach me at user{k}@mail.example.com {prose(k + 50, 5)}") for k in range(12)] + [(100, f"{prose(1, 6)} please reach me at KX4930021Q {prose(2, 5)}"), (101, f"{prose(3, 6)} of KX4930021Q {prose(4, 5)}")]
    out = {r["doc_id"]: r for r in pii.find_pii(frame(spark, rows)).collect()}
    start = rows[12][1].index("KX")
    assert out[100]["spans"] == f"id:{start}:{start + 10}" and out[100]["n_id"] == 1 and out[101]["n_id"] == 0 and out[0]["n_email"] == 1


def test_pii_finds_held_out_identifiers(spark):
    """Identifiers of any length behind the pattern of telling ones; other values, and strings elsewhere, stay out."""
    digest = lambda k: hashlib.sha1(str(k).encode()).hexdigest()
    rows = [(k, f'{prose(k, 8)} token = "{digest(k)}" {prose(k + 1, 4)}') for k in range(20)]
    held_out = [(100 + k, f'{prose(k, 5 + k)} token = "{digest(k)[: 7 + k % 9]}9" {prose(k, 3)}') for k in range(30)]
    plain = [(200 + k, f'{prose(k, 5)} colour = "blue{k}00000" size = "large" {prose(k, 3)}') for k in range(10)]
    elsewhere = [(300 + k, f"{prose(k, 9)} {digest(900 + k)} {prose(k, 4)}") for k in range(10)]
    names = [(400 + k, f'{prose(k, 5)} name = "{w}"') for k, w in enumerate(WORDS)] + [(450 + k, f'{prose(k, 5)} name = "{digest(k)}"') for k in range(6)]
    out = {r["doc_id"]: r["spans"] for r in pii.find_pii(frame(spark, rows + held_out + plain + elsewhere + names)).collect()}
    for i, text in rows + held_out:
        start = text.index('"') + 1
        end = text.index('"', start)
        assert out[i] == (f"id:{start}:{end}" if re.search("[0-9][A-Za-z0-9]{5}", text[start:end]) else "")
    assert sum(out[i] != "" for i, _ in held_out) >= 27
    assert not any(out[i] for i, _ in plain + elsewhere + names)


def test_pii_in_the_given_tables(spark, small):
    """Of the tokens in the given texts' one marked context all are found."""
    docs = spark.read.parquet(f"{small}/documents.parquet".replace("sf0.001", "sf0.01"))
    want = {r["doc_id"]: len(re.findall(r'token = "[0-9a-f]{40}"', r["text"])) for r in docs.collect()}
    got = {r["doc_id"]: r["n_id"] for r in pii.find_pii(docs).collect()}
    assert got == want and sum(got.values()) >= 10


# 8
def test_token_store(spark):
    path = queries.WORDS
    rows = ODD + [(k, f"{prose(k, 40)}, It's Ünder-way!! 42% <|endoftext|> don't\r\nΣΑΣ") for k in range(150)]
    tokenizer = Tokenizer.from_file(path)
    ids = [(i, np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for i, t in rows]
    out = sorted(token_store.token_store(frame(spark, rows), path).collect(), key=lambda r: r["start"])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out) == Counter((i, len(x) // 4, zlib.crc32(x)) for i, x in ids)
    starts = np.cumsum([0] + [r["n_tokens"] for r in out])
    assert [r["start"] for r in out] == starts[:-1].tolist()
    order = [r["doc_id"] if r["doc_id"] is not None else -1 for r in out]
    assert order == sorted(order)
    assert token_store.token_store(empty(spark), path).count() == 0


def test_shard_reads_one_document(spark):
    path, folder = queries.WORDS, scratch(spark, "ids")
    docs = frame(spark, [(k, prose(k, 30)) for k in range(100)])
    dictionary = token_store.train_dictionary(docs, path)
    shards = token_store.write_shards(docs.select("doc_id", "text"), folder, path, dictionary, 2).collect()
    shard = token_store.Shard(shards[0]["path"], dictionary)
    k = len(shard.index) - 1
    text = prose(int(shard.index["doc_id"][k]), 30)
    assert dictionary and np.frombuffer(shard.ids(k), "<u4").tolist() == [*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 2]
    with pytest.raises(ValueError):
        token_store.Shard(shards[0]["path"], b"another")


# 9
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/">Home page</a><li><a href=/b>About us</a></ul></nav><div class="cookie-notice">We use cookies here</div>{open}<h1>Title &amp; more</h1>
<p>First <b>bold</b>ness of the&nbsp;article, and &lt;tags&gt;.<p>Second   part<br>goes on.<div class="ad">Buy now</div><form><input><label>Mail</label></form><p>Third.{close}
<aside>Related one two three four</aside><section id="comments"><p>Great post, thanks a lot</p></section><footer>&copy; 2024</footer></body></html>"""
TEXT = "Title & more First boldness of the article, and <tags>. Second part goes on. Third."


def test_main_text(spark):
    rows = [(k, f"http://s/{k}", PAGE.format(open=o, close=c)) for k, (o, c) in enumerate([("<article>", "</article>"), ("<main>", "</main>"), ('<div id="content">', "</div>"), ("", ""), ('<div class="page with-sidebar">', "</div>")])]
    odd = [(None, None, None), (50, "u", ""), (51, "u", "<p"), (52, "u", "plain words only"), (53, "u", "<nav>menu</nav>"), (53, "u", "<nav>menu</nav>"), (54, "u", "<article>" + "<p>long words " * 20_000)]
    pages = spark.createDataFrame([(*r, "t") for r in rows + odd], "page_id long, url string, html string, text string")
    out = main_text.main_texts(pages, main_text.fit(pages))
    got = Counter((r["page_id"], r["text"], r["n_chars"]) for r in out.collect())
    want = [(k, TEXT) for k, _, _ in rows] + [(None, ""), (50, ""), (51, "<p"), (52, "plain words only"), (53, ""), (53, ""), (54, " ".join(["long words"] * 20_000))]
    assert got == Counter((i, t, len(t)) for i, t in want)
    assert main_text.main_texts(pages.limit(0), main_text.fit(pages.limit(0))).count() == 0


def test_best_region():
    rng = np.random.default_rng(0)
    for _ in range(100):
        s = rng.integers(-3, 4, rng.integers(0, 9)).astype(float).tolist()
        best = max([0.0] + [sum(s[a:b]) for a in range(len(s)) for b in range(a + 1, len(s) + 1)])
        a, b = main_text.best_region(s)
        assert sum(s[a:b]) == best


STORY = [f"<div><p>{prose(40 + k, 60)}</p></div>" for k in range(5)]
TEASER = f"<article><h2>{prose(1, 4)}</h2><p>{prose(2, 12)}</p></article>"
LAYOUTS = {
    "none": ["<div>", *STORY, "</div>"],
    "teaser before": [TEASER, "<div>", *STORY, "</div>"],
    "teaser after": ["<div>", *STORY, "</div>", TEASER],
    "story and teaser outside": ["<article>", *STORY, "</article>", f"<div><p>{prose(3, 15)}</p></div>"],
    "several": [f"<article>{x}</article>" for x in STORY],
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_region_is_the_best_one(name):
    """The output is the text of the best of all regions, also where the only article element is a teaser."""
    weights = {"word p": 4.0, "word h2": 4.0, "tag p": -0.05, "tag div": -0.3, "edge": -97.0}
    source = f"<html><body><nav><a>Home</a></nav>{''.join(LAYOUTS[name])}<footer>Imprint</footer></body></html>"
    page = main_text.read_page(source)
    scores = np.cumsum([0.0, *main_text.scores_of(page, weights)])
    best = max(scores[b] - scores[a] for a in range(len(scores)) for b in range(a, len(scores)))
    texts = {main_text.text_of(page, a, b) for a in range(len(scores)) for b in range(a, len(scores)) if scores[b] - scores[a] > best - 1e-9}
    assert texts == {main_text.extract(source, weights)} == {" ".join(prose(40 + k, 60) for k in range(5))}


def overlap(got: str, want: str) -> float:
    """F1 of two texts' words."""
    a, b = Counter(got.split()), Counter(want.split())
    return 2 * sum((a & b).values()) / max(sum(a.values()) + sum(b.values()), 1)


@pytest.mark.parametrize("hidden", ["article", "article and classes"])
def test_region_is_found_without_names(spark, monkeypatch, hidden):
    """Held-out pages whose article element has become a div, with no list of class words: the learned weights find the text, and the whole page is another."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    weights = main_text.fit(pages.where("page_id % 2 = 0"))
    sources = [r["html"] for r in pages.where("page_id % 2 = 1").collect()]
    want = [main_text.text_of(p, p.inside.index(True), len(p.inside) - p.inside[::-1].index(True)) for p in map(main_text.read_page, sources)]
    monkeypatch.setattr(main_text, "HINTS", frozenset())
    changed = [re.sub("<(/?)article", r"<\1div", x) for x in sources]
    if hidden == "article and classes":
        changed = [x.replace(' class="ad"', "") for x in changed]
    found = [overlap(main_text.extract(x, weights), w) for x, w in zip(changed, want)]
    whole = [main_text.text_of(p, 0, len(p.kinds)) for p in map(main_text.read_page, changed)]
    assert np.mean(found) >= 0.98 and sum(w != x for w, x in zip(want, whole)) > 0.9 * len(want)


def test_the_region_makes_the_result(spark):
    """On all given pages the result is the article's text, and the whole page in the region's place is another."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    weights = main_text.fit(pages)
    sources = [r["html"] for r in pages.collect()]
    for source in sources:
        known, page = main_text.read_page(source), main_text.read_page(source, frozenset())
        want = main_text.text_of(known, known.inside.index(True), len(known.inside) - known.inside[::-1].index(True))
        assert main_text.extract(source, weights) == want != main_text.text_of(page, 0, len(page.kinds), weights)


# 10
def test_site_quality(spark):
    good = [(k, prose(k, 60).capitalize() + ".", "clean" if k % 2 else "mixed") for k in range(120)]
    bad = [(200 + k, " ".join(["BUY!!", "NOW***", "$$$"] * 15) + prose(k, 3), "dirty" if k % 2 else "mixed") for k in range(120)]
    docs = spark.createDataFrame([(i, t, "en", s, 0, "x") for i, t, s in good + bad] + [(None, None, None, None, 0, "x"), (900, "", "en", "tiny", 0, "x")], "doc_id long, text string, lang string, source string, n_chars long, p string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in good[::2]] + [(i, 0, 0) for i, _, _ in bad[::2]], "doc_id long, quality int, toxic int")
    out = site_quality.classify(docs, labels)
    assert out.columns == [*docs.columns, "tidemark_quality"]
    rows = {r["doc_id"]: r["tidemark_quality"] for r in out.collect()}
    assert len(rows) == 242 and all(rows[i]["kept"] for i, _, _ in good) and not any(rows[i]["kept"] for i, _, _ in bad)
    assert rows[201]["prior"] < rows[0]["prior"] < rows[1]["prior"]
    plain = site_quality.classify(docs, labels.limit(0))
    assert plain.where("tidemark_quality.kept").count() == 242 and site_quality.classify(docs.limit(0), labels).count() == 0


def test_site_quality_against_brute_force(spark):
    """The hierarchy by plain sums, with repeated rows, ties, a very long text, null sites and a sparse one."""
    rng = np.random.default_rng(5)
    rows = [(k, prose(k, 30) + " !!" * int(rng.integers(0, 9)), f"s{k % 4}" if k % 13 else None, ("en", "de", None)[k % 3]) for k in range(120)]
    rows += rows[:10] + [(900, "Word " * 30_000, "long", "en"), (901, rows[1][1], "s1", "de"), (902, rows[1][1], "s1", "de"), (None, None, "s2", None)]
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, source string, lang string, n_chars long, host string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(0, 120, 3)], "doc_id long, quality int, toxic int")
    out = site_quality.classify(docs, labels).select("doc_id", "source", "lang", "tidemark_quality.*").collect()
    assert len(out) == len(rows)
    p = np.array([1 / (1 + np.exp(-r["evidence"])) for r in out])
    host, path = [r["source"] for r in out], [(r["source"], r["lang"]) for r in out]
    groups = lambda keys: {k: p[[x == k for x in keys]] for k in set(keys)}

    def strength(n, m, var, prior):
        n, m, var, prior = map(np.array, (n, m, var, prior))
        between = max((n * (m - prior) ** 2).sum() - var.sum(), 0) / n.sum()
        return min(1000.0, max(2.0, (n * prior * (1 - prior)).sum() / n.sum() / between - 1 if between > 0 else 1000.0))

    paths, mean = groups(path), p.mean()
    # A host's variance is the mean of its paths' own.
    hosts = {h: (len(v), v.mean(), np.mean([x.var() for k, x in paths.items() if k[0] == h])) for h, v in groups(host).items()}
    k = strength(*zip(*[(n, m, v) for n, m, v in hosts.values()]), [mean] * len(hosts))
    prior_h = {h: (n * m + k * mean) / (n + k) for h, (n, m, _) in hosts.items()}
    keys = list(paths)
    k = strength([len(paths[x]) for x in keys], [paths[x].mean() for x in keys], [paths[x].var() for x in keys], [prior_h[x[0]] for x in keys])
    prior = {x: (paths[x].sum() + k * prior_h[x[0]]) / (len(paths[x]) + k) for x in keys}
    for r, x in zip(out, path):
        assert abs(r["prior"] - prior[x]) < 1e-6
        total = r["evidence"] + np.log(prior[x] / (1 - prior[x])) - np.log(mean / (1 - mean))
        assert abs(r["posterior"] - 1 / (1 + np.exp(-total))) < 1e-6 and r["kept"] == (r["posterior"] >= 0.5)
    assert len({(r["posterior"]) for r in out if r["doc_id"] in (901, 902)}) == 1


def test_components(spark):
    chain = [(k, k + 1) for k in range(60)] + [(100, 105), (105, 103), (7, 7), (200, 200)]
    out = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert out == {k: 0 for k in range(61)} | {100: 100, 105: 100, 103: 100}


# pipeline
def test_pipeline(spark, small):
    import corpus_pipeline

    from tidemark.llm.common import written

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, left = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = left.count()
        left = written(stage(spark, left, small), name)
        assert 0 < left.count() <= before
        assert left.columns == (columns if k + 1 < len(corpus_pipeline.STAGES) else ["doc_id", "ids"])


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_anything(spark, small, stage):
    """Nulls in every column, empty and very long texts, repeated rows and ids, clashing columns' values, and an empty table."""
    import corpus_pipeline

    columns = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(i, t, None, None, None) for i, t in ODD] + [(5, prose(5, 50), "en", "s", 1)] * 2 + [(5, prose(6, 50), "en", "s", 2), (None, prose(7, 40), None, "s", None), (6, "a\n" * 3_000, "en", None, 0)]
    docs = spark.createDataFrame(odd, columns)
    run = corpus_pipeline.STAGES[stage][1]
    out = run(spark, docs, small).collect()
    assert len(out) <= len(odd) and run(spark, docs.limit(0), small).count() == 0
    if stage < 4:
        rows = Counter(map(tuple, odd))
        assert run(spark, docs, small).columns == docs.columns
        if stage != 1:  # the line stage changes texts
            assert not Counter(map(tuple, out)) - rows
        assert stage == 0 or {5, None} <= {r["doc_id"] for r in out}
    else:
        assert len(out) == len(odd) and {len(r["ids"]) for r in out if r["doc_id"] == 902} == {0}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, small, name):
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    cols = [x[0] for x in want.description]
    assert Counter(tuple(r[c] for c in cols) for r in queries.QUERIES[name](spark, small).collect()) == Counter(want.fetchall())
