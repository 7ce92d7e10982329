"""The operators against brute force, round trips and held-out accuracy, with nulls, empty texts, ties and repeated rows."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from concourse.llm import byte_bpe, html_text, language_id, line_dedup, media, near_dedup, packing, substring_dedup, top_k, unigram_counts
from concourse.llm.pretokens import splitter

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN
ODD = [None, "", " \n\t ", "word", "word", "ñandú été Straße 漢字 🙂 <|endoftext|>", "it's  two   spaces\n\nand lines ", "a" * 700, "x y " * 300]


def table(spark, texts, more=""):
    """Documents with a clashing extra column."""
    return spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, k string")


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def test_encoding_equals_the_library_and_round_trips(spark):
    import tiktoken

    lines = map(bytes.split, open(RANKS, "rb"))
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in lines}, special_tokens={})
    rows = byte_bpe.decode(byte_bpe.encode(table(spark, ODD), RANKS, PATTERN), RANKS).collect()
    for r in rows:
        text = ODD[r["doc_id"]] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == enc.encode_ordinary(text) and r["decoded"] == text.encode() and r["n_tokens"] * 4 == len(r["ids"])
    assert byte_bpe.encode(table(spark, ODD).limit(0), RANKS, PATTERN).count() == 0


def test_unigram_counts_equal_plain_dynamic_programming(spark):
    model, longest = unigram_counts.scores(RANKS)

    def best(w: bytes) -> tuple[int, int]:
        at = [(0, 0)] + [None] * len(w)
        for i in range(1, len(w) + 1):
            at[i] = max((at[j][0] + model[w[j:i]], at[j][1] - 1) for j in range(max(0, i - longest), i) if w[j:i] in model)
        return at[-1]

    for r in unigram_counts.count_tokens(table(spark, ODD), RANKS, PATTERN).collect():
        words = [w.encode() for w in splitter(PATTERN)(ODD[r["doc_id"]] or "")]
        assert (r["n_pretokens"], r["n_tokens"]) == (len(words), -sum(best(w)[1] for w in words))


def test_packing_keeps_every_id_once(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    texts = [*ODD, *[prose(i, 5 + 60 * i) for i in range(12)]]
    rows = packing.pack(table(spark, texts), JSON, PATTERN, capacity=64, group=10).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    for i, text in enumerate(texts):
        ids, at = [*t.encode(text or "", add_special_tokens=False).ids, 0], 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        assert [o for o, _ in sorted(parts)] == np.r_[0, np.cumsum([n for _, n in sorted(parts)])[:-1]].tolist() and sum(n for _, n in parts) <= 64


def test_packing_keeps_large_and_null_ids(spark):
    big = 2**60
    rows = [(None, "a b"), (big + 1, "a b"), (big + 3, "a c"), (big + 3, "a c"), (None, None)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("q")), JSON, PATTERN).collect()
    assert Counter(r["doc_id"] for r in got) == {None: 2, big + 1: 1, big + 3: 2} and len({(r["sequence_id"], r["offset"]) for r in got}) == 5
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), JSON, PATTERN).count() == 0


def test_first_fit_decreasing_is_first_fit():
    sizes = np.random.default_rng(0).integers(1, 101, 500)
    got, offset = packing.first_fit_decreasing(sizes, 100)
    room, want = [], {}
    for i in np.argsort(-sizes, kind="stable"):
        k = next((k for k, left in enumerate(room) if left >= sizes[i]), len(room))
        room += [100] * (k == len(room))
        want[i] = (k, 100 - room[k])
        room[k] -= sizes[i]
    assert {i: (got[i], offset[i]) for i in want} == want


def test_near_duplicates_equal_brute_force(spark):
    base = [prose(i, 60) for i in range(6)]
    texts = [None, "", "One", "one", "two words", *base]
    r = random.Random(3)
    for b in base:
        for _ in range(5):
            w = b.split()
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = r.choice("pqrs")
            texts.append(" ".join(w))
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w)} if len(w) == 1 else set(zip(w, w[1:])))
    top = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    top[i] = min(top[i], top[j])
    rows = near_dedup.near_duplicates(table(spark, texts), width=2).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in rows} == {i: (len(sets[i]), top[i], top[i] == i) for i in range(len(texts))}
    assert near_dedup.near_duplicates(table(spark, texts).limit(0)).count() == 0


def test_near_duplicates_with_repeated_and_null_ids(spark):
    a, b, c = prose(60, 80), prose(61, 80), prose(62, 80)
    rows = [(5, a), (5, b), (7, a + " zz"), (8, b + " zz"), (9, c), (9, c), (None, c), (None, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' k", "1L n_shingles", "2L h")
    found = near_dedup.near_duplicates(docs, width=2).collect()
    assert sorted((x["doc_id"] or -1, x["component_id"] or -1, x["kept"]) for x in found) == [(-1, -1, False), (-1, 9, False), (4, 4, True), (5, 5, True), (5, 5, True), (7, 5, False), (8, 5, False), (9, 9, True), (9, 9, True)]
    left = near_dedup.one_of_each(docs, width=2)
    assert left.columns == docs.columns
    assert sorted((x["doc_id"] or -1, x["text"] or "") for x in left.collect()) == sorted([(5, a), (5, b), (9, c), (-1, ""), (4, "")])


def test_large_buckets_lose_no_link(spark, monkeypatch):
    from concourse.llm import components

    monkeypatch.setattr(components, "SMALL", 4)
    keyed = spark.createDataFrame([(i, 10, [1, 2, *[100 + i // 3 * 10 + j for j in range(8)]]) for i in range(60)], "id long, n long, keys array<long>")
    members = components.shared_buckets(keyed)
    label = components.bucket_components(members, keyed, 0.8, lambda pairs: pairs.where("floor(a / 3) = floor(b / 3)"))
    assert {x["id"]: x["component"] for x in label.collect()} == {i: i // 3 * 3 for i in range(60)}


def test_tiles_of_large_buckets_lose_no_link(spark, monkeypatch):
    """Many pairs of near copies made from one template, so that buckets hold members of many components, against brute force."""
    from concourse.llm import components

    monkeypatch.setattr(components, "SMALL", 4)
    monkeypatch.setattr(components, "TILE", 16)
    shared, r, texts = prose(900, 60).split(), random.Random(8), []
    for i in range(60):
        own = [*shared, *prose(1000 + i, 30).split()]
        other = list(own)
        for at in r.sample(range(len(own)), 4):
            other[at] = "changed"
        texts += [" ".join(own), " ".join(other)]
    sets = [set(zip(t.split(), t.split()[1:])) for t in texts]
    top = list(range(len(texts)))
    links = [(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for _ in texts:
        for i, j in links:
            top[i] = top[j] = min(top[i], top[j])
    assert len(set(top)) > 20 and len(links) >= 50
    for parts in (4, 11):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        rows = near_dedup.near_duplicates(table(spark, texts), width=2).collect()
        assert {x["doc_id"]: x["component_id"] for x in rows} == dict(enumerate(top))
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_pairs_in_buckets_of_thousands_are_all_linked(spark):
    """4,000 pairs at band agreement 0.8^7, whose shared buckets hold up to some 2,000 members."""
    from concourse.llm import components

    r = np.random.default_rng(5)
    pairs, bands = 4000, near_dedup.BANDS
    one = r.integers(0, 4, (pairs, bands)) * 64 + np.arange(bands)
    two = np.where(r.random((pairs, bands)) < 0.8**7, one, r.integers(4, 8, (pairs, bands)) * 64 + np.arange(bands))
    sig = r.integers(0, 2**32, (pairs, near_dedup.SIGNATURE), np.uint32)
    near = np.where(r.random(sig.shape) < 0.8, sig, r.integers(0, 2**32, sig.shape, np.uint32))
    rows = [(2 * i + e, 100, k[i].tolist(), bytearray(s[i].tobytes())) for i in range(pairs) for e, k, s in ((0, one, sig), (1, two, near))]
    keyed = spark.createDataFrame(rows, "id long, n long, keys array<long>, sig binary").repartition(8).cache()
    members = components.shared_buckets(keyed.select("id", "n", "keys"))
    assert members.groupBy("k").count().agg({"count": "max"}).first()[0] > 900
    # only the two of a pair share shingles
    sets = keyed.selectExpr("id", "transform(sequence(0L, 99L), i -> floor(id / 2) * 100 + i) AS names")
    label = components.bucket_components(members, keyed.select("id", "keys"), 0.8, lambda p: p.where("floor(a / 2) = floor(b / 2)"), near_dedup._screen(keyed, sets, 80, near_dedup.MISS))
    linked = {x["id"] // 2 for x in label.collect()}
    want = set(np.flatnonzero((one == two).any(axis=1)).tolist())
    assert len(want - linked) == 0 and linked <= want


def test_names_of_words_tell_mirrored_words_apart(spark):
    """Two words of 1,024 letters, of which one has a and b exchanged by the Thue-Morse sequence, have equal sums of powers modulo 2^64."""
    one = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    assert near_dedup.shingle_set(one, 2)[0] != near_dedup.shingle_set(two, 2)[0]
    words = ["a", "a\0", "aaaaaaaa", "aaaaaaaa\0", "b" * 63, "b" * 64, "b" * 65, "é", "x" * 700]
    alone = [near_dedup.shingle_set(w, 2)[0] for w in words]
    assert len(set(alone)) == len(words)
    within = near_dedup._word_names(" ".join(["zz", *words, "zz"]).encode())[1][1:-1]
    assert [int(near_dedup._word_names(w.encode())[1][0]) for w in words] == within.tolist()
    rows = near_dedup.near_duplicates(table(spark, [one, two, f"{one} x y", f"{two} x y"]), width=2).collect()
    assert [x["kept"] for x in rows] == [True] * 4


def test_posterior_bound_drops_few_true_pairs():
    least = near_dedup.least_matches(0.8, 1e-7, 128, 16)
    draws = np.random.default_rng(1).random((20000, 128)) < 0.8
    upto = np.cumsum(draws, axis=1)[:, 15::16]
    assert (upto < np.array(least)).any(axis=1).mean() < 1e-3


def test_repeats_equal_brute_force(spark):
    shared = prose(50, 20)
    texts = [None, "", "short", prose(1, 40) + shared + prose(2, 30), prose(3, 10) + shared, shared + " é" * 30 + shared[:70], "ab" * 90, prose(4, 50), prose(4, 50)]
    texts += [texts[3], "one more " + prose(51, 30)] + [texts[7]] * 30
    length = 60
    seen = Counter(b[p : p + length] for t in texts for b in [(t or "").encode()] for p in range(len(b) - length + 1))
    rows = {r["doc_id"]: r for r in substring_dedup.remove_repeats(table(spark, texts), length=length, gram=20).collect()}
    for i, t in enumerate(texts):
        b, mark = (t or "").encode(), bytearray(len((t or "").encode()))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                mark[p : p + length] = b"\1" * length
        kept = bytes(x for x, m in zip(b, mark) if not m)
        runs = sum(m and not p for p, m in zip([0, *mark], mark))
        assert (rows[i]["n_bytes"], rows[i]["n_removed"], len(rows[i]["spans"]), rows[i]["kept_sha256"]) == (len(b), sum(mark), runs, hashlib.sha256(kept).hexdigest())
        assert rows[i]["kept_text"] == kept.decode("utf-8", "ignore")
    assert substring_dedup.remove_repeats(table(spark, texts).limit(0)).count() == 0


def test_lines_are_kept_once(spark):
    one = "The quick brown fox jumps over the lazy dog and runs far away from the farm"
    texts = [f"{one}\nshort line\n{prose(1, 12)}", f"{one.upper()}!!\nshort line", None, "", f"{prose(2, 12)}\n{one}\n{one} 42"]
    rows = {r["doc_id"]: r for r in line_dedup.dedup_lines(table(spark, texts), min_words=5).collect()}
    assert rows[0]["text"] == texts[0] and rows[1]["text"] == "short line" and rows[2]["text"] is None and rows[3]["text"] == ""
    assert rows[4]["text"] == prose(2, 12) and (rows[4]["n_lines"], rows[4]["n_removed"]) == (3, 2)


def test_lines_of_any_length_take_part_and_digits_count(spark):
    texts = ["short line\n\n\t\nitem number 1024 of day 17", "Short, line\n\n\nitem number 9 of day 4", "--\n漢字仮名交じり文の一行です\n \n--", "漢字仮名交じり文の一行です"]
    rows = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(table(spark, [*texts, texts[0]])).collect()}
    assert rows == {0: texts[0], 1: "\n\nitem number 9 of day 4", 2: "--\n漢字仮名交じり文の一行です\n ", 3: "", 4: "\n\t"}
    assert line_dedup.dedup_lines(table(spark, texts).limit(0)).count() == 0


def test_changed_lines_are_found(spark):
    """Lines with one letter or a fifth of the words changed, against their edit similarity."""
    r = random.Random(4)
    texts, want = [], 0
    for n in (5, 10, 25, 60):
        for i in range(40):
            words = [*prose(1000 * n + i, n).split()]
            other = list(words)
            for at in r.sample(range(n), n // 5 if i % 2 else 1):
                other[at] = other[at][:-1] + "z" if i % 2 == 0 else prose(7000 * n + i + at, 1)[: len(other[at])].ljust(len(other[at]), "y")
            texts += [" ".join(words), " ".join(other)]
            want += 1
    found = sum(r["n_removed"] for r in line_dedup.dedup_lines(table(spark, texts)).collect())
    assert 0.9 * want <= found <= want


def test_long_lines_link_by_their_parts_or_as_a_whole(spark):
    """Long lines of the same words: an edit in place is accepted by parts, a moved half is not near."""
    words = prose(3, 800).split()
    changed = words[:400] + ["zzz"] + words[401:]
    moved = words[400:] + words[:400]
    rows = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(table(spark, [" ".join(w) for w in (words, changed, moved)])).collect()}
    assert rows == {0: 0, 1: 1, 2: 0}


def test_long_lines_out_of_step_are_compared_exactly(spark):
    """Lines of over 512 characters with a clause put in near their start, or their first words cut: near, though their parts fall out of step."""
    texts = []
    for i in range(6):
        words = prose(600 + i, 130).split()
        other = words[:3] + prose(900 + i, 9).split() + words[3:] if i % 2 else words[9:]
        texts += [" ".join(words), " ".join(other)]
    assert min(map(len, texts)) > 512
    rows = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(table(spark, texts)).collect()}
    assert rows == {i: i % 2 for i in range(len(texts))}


def test_the_short_test_of_a_line_agrees_with_its_normal_form(spark):
    lines = ["", " ", "a b c d e", "a b c d", "1 2 3 4 5", " 1 2 3 4", "a1b2c3d4e", "é,è;ü:ö ñ!", "x" * 5000, "1 " * 9, "--a b c d e--"]
    t = table(spark, lines).select(line_dedup.normalised(F.col("text")).alias("text")).select(line_dedup.has_words(F.col("text"), 5).alias("quick"), (F.size(F.split(F.col("text"), " ")) >= 5).alias("plain"))
    assert all(r["quick"] == r["plain"] for r in t.collect())


def test_language_model_learns_and_knows_what_it_cannot_tell(spark):
    words = {"aa": "abcde", "bb": "fghij", "cc": "klmno"}
    r = random.Random(5)
    rows = [(i, " ".join("".join(r.choice(words[k]) for _ in range(5)) for _ in range(15)), k) for i, k in enumerate(list(words) * 60)]
    model = language_id.fit(spark.createDataFrame([x for x in rows if x[0] % 4], "doc_id long, text string, lang string"))
    test = [x for x in rows if x[0] % 4 == 0]
    got = language_id.identify(spark.createDataFrame([*[(i, t) for i, t, _ in test], (900, None), (901, "12 !")], "doc_id long, text string"), model).collect()
    by = {g["doc_id"]: g for g in got}
    assert np.mean([by[i]["lang_pred"] == k for i, _, k in test]) > 0.95
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (900, 901)) and all(0 <= g["score"] <= 1 for g in got)
    empty = language_id.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert empty.predict("text") == ("und", 0.0)


PAGE = "<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><a href=1>Home</a></nav><div class='ad'>Buy this now, good people of the town.</div><article><h1>A &amp; B</h1><p>One  two\nthree&nbsp;four, and some more words to read.<p>Yes.<aside>Read also this other long piece of text.</aside></article><footer>End of it</footer>"


def test_main_text(spark):
    rows = spark.createDataFrame([(1, "u", PAGE, 5), (2, "u", None, 5), (3, None, "", 5), (4, "u", "<a", 5)], "page_id long, url string, html string, text int")
    got = {r["page_id"]: r for r in html_text.extract(rows).collect()}
    assert got[1]["text"] == "A & B\nOne two three four, and some more words to read.\nYes." and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == got[3]["text"] == ""


def test_top_k_equals_brute_force(spark):
    r = np.random.default_rng(0)
    v = [[float(x) for x in r.normal(size=6)] for _ in range(300)]
    v[7] = v[8] = v[9] = v[0]
    rows = [(i, x) for i, x in enumerate(v)] + [(1000, None), (1050, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0]), (1100, [None, 1.0, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    m = np.floor(np.array(v) * 256).astype(np.int64)
    want = [(q, k + 1, j, -s) for q in range(0, 300, 50) for k, (s, j) in enumerate(sorted((-int(m[q] @ m[j]), j) for j in range(300) if j != q)[:5])]
    got = top_k.top_k(df.where("vec_id % 50 = 0"), df).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    few = df.where("vec_id < 3")
    assert top_k.top_k(few.where("vec_id = 0"), few).count() == 2 and top_k.top_k(df.limit(0), df.limit(0)).count() == 0


def test_blocks_of_queries_are_not_broadcast(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(40)], "vec_id long, embedding array<float>")
    plan = top_k.top_k(rows.where("vec_id % 5 = 0"), rows)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_media_round_trip(spark):
    texts = [*ODD, prose(1, 4000)]
    rows = media.stored_features(media.store_texts(table(spark, texts))).collect()
    for r in rows:
        b = (texts[r["doc_id"]] or "").encode()
        p = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    with pytest.raises(ValueError):
        media.decode_images([b"RIFF....WEBPjunk"])


def edit_distance(a: str, b: str) -> int:
    last = np.arange(len(b) + 1)
    letters, at = np.array(list(b)), np.arange(len(b) + 1)
    for i, c in enumerate(a, 1):
        now = np.concatenate([[i], np.minimum(last[:-1] + (letters != c), last[1:] + 1)])
        last = np.minimum.accumulate(now - at) + at
    return int(last[-1])


def test_near_lines_meet_at_the_stated_similarity(spark):
    """Recall against brute force: a line and a copy with as many words replaced as edit similarity 0.8 allows."""
    r, texts, sizes = random.Random(8), [], []
    for n in (5, 10, 20, 40, 100):
        for i in range(60):
            line = prose(10000 * n + i, n).split()
            copy = None
            for k in r.sample(range(n), n):
                more = (copy or line)[:k] + [prose(r.random(), 1)] + (copy or line)[k + 1 :]
                one, two = " ".join(line), " ".join(more)
                if 1 - edit_distance(one, two) / max(len(one), len(two)) < 0.8:
                    break
                copy = more
            if copy:
                texts.append(f"{' '.join(line)}\n{' '.join(copy)}")
                sizes.append(n)
    rows = {x["doc_id"]: x["n_removed"] for x in line_dedup.dedup_lines(table(spark, texts)).collect()}
    recall = {n: np.mean([rows[i] for i, m in enumerate(sizes) if m == n]) for n in set(sizes)}
    assert len(recall) == 5 and min(recall.values()) > 0.85 and np.mean(list(rows.values())) > 0.9, recall


def test_lines_without_blanks_are_compared(spark):
    line = "今日は天気がとても良いので公園まで歩いて行きました"
    rows = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(table(spark, [line, f"{line}。", line.replace("公園", "学校")])).collect()}
    assert rows == {0: 0, 1: 1, 2: 1}


def test_text_after_empty_or_unclosed_elements_stays():
    for tag in ("<svg a='b'/>", "<math/>", "<object>", "<video src=x>", "<audio>", "<canvas>"):
        assert [b[0] for b in html_text.blocks(f"<p>one</p>{tag}<p>two</p>")] == ["one", "two"], tag
    assert [b[0] for b in html_text.blocks("<p>one</p><svg/><p>two</p><svg><text>x</text></svg><p>three <math><mi>y</mi></math></p>")] == ["one", "two", "three y"]
    assert [b[0] for b in html_text.blocks("<p>one</p><script>var a = '<p>two</p>'")] == ["one"]


def test_lines_of_large_buckets_lose_no_link(spark, monkeypatch):
    """Pairs of near lines in one bucket of lines of many components, as their passage in common fills the sketch, against brute force; with a clause put in, too, which no comparison by parts follows."""
    from concourse.llm import components

    monkeypatch.setattr(components, "SMALL", 4)
    monkeypatch.setattr(line_dedup, "TILE", 16)
    monkeypatch.setattr(line_dedup, "PIVOTS", 2)
    # the words of least hash of the lot, so that they are the sketch of each line
    words = sorted({w for i in range(100) for w in prose(3000 + i, 20).split() if len(w) >= line_dedup.LONG})
    order = spark.createDataFrame([(w,) for w in words], "w string").selectExpr("w", "xxhash64(w) & ((1L << 61) - 1) AS h").orderBy("h")
    shared = [x["w"] for x in order.limit(5).collect()]
    r, lines = random.Random(9), []
    for i in range(30):
        own = [*shared, *["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(40)]]
        other = own[:10] + ["zz"] * 14 + own[10:] if i % 2 else [w if k % 9 else "yyyy" for k, w in enumerate(own, 4)]
        lines += [" ".join(own), " ".join(other)]
    top = list(range(len(lines)))
    links = [(i, j) for j in range(len(lines)) for i in range(j) if edit_distance(lines[i], lines[j]) <= int(0.2 * max(len(lines[i]), len(lines[j])) + 1e-9)]
    for _ in lines:
        for i, j in links:
            top[i] = top[j] = min(top[i], top[j])
    assert len(links) >= 25
    rows = {x["doc_id"]: x["n_removed"] for x in line_dedup.dedup_lines(table(spark, lines)).collect()}
    assert rows == {i: int(top[i] != i) for i in range(len(lines))}
