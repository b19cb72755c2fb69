"""Corpus operators against brute force on small tables with every awkward row."""

import datetime
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickersift.llm import pseudonyms, queries, repeats, simhash
from tickersift.llm.adaptive_search import approximate_top_k
from tickersift.llm.components import connected_components
from tickersift.llm.language import fit_languages, predict_languages, subwords
from tickersift.llm.line_templates import drop_recurring_lines
from tickersift.llm.mixing import mix_sources, mixed_documents
from tickersift.llm.packing import WordIds, best_fit_decreasing, pack_documents
from tickersift.llm.pivot_search import exact_top_k
from tickersift.llm.pseudonyms import pseudonymised
from tickersift.llm.repeats import repeated_bytes
from tickersift.llm.sharding import shuffled_shards, write_shards
from tickersift.llm.simhash import near_duplicates, near_links, text_fingerprint

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, prediction int, size int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    base = [prose(n) for n in (1, 2, 3, 5, 90, 200, 400, 3000)]
    texts = [None, "", " \n\t ", "!!!", "é" * 50, "a" * 3000, "ab" * 700, *base, *base[4:], base[5], base[5]]
    texts += [base[6].replace(" ", "  ", 1).upper(), base[6][:-9] + " changed", prose(40) + "\n" + base[5] + "\n" + prose(9)]
    texts += [f"line {i} of mail\n" + prose(30) for i in range(12)]
    out = [(i, t, "xy"[i % 2] if i % 5 else None, (None, "s", "t", "é")[i % 4], len(t or "")) for i, t in enumerate(texts)]
    out += [out[10], out[10], (None, base[5], None, None, 0), (None, None, None, None, None)]
    return [(*r, "clash", i, 7) for i, r in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "empty.parquet")
    docs.where("false").write.parquet(path)
    return spark.read.parquet(path)


def tokenizer():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def fingerprint(text, words):
    from xxhash import xxh64_intdigest

    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    hashes = [xxh64_intdigest(" ".join(w[i : i + words]).encode(), 42) for i in range(max(1, len(w) - words + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates_equal_brute_force(docs, rows):
    prints = [fingerprint(r[1], 4) for r in rows]
    group = list(range(len(rows)))
    for _ in rows:
        group = [min(group[j] for j in range(len(rows)) if (prints[i] ^ prints[j]).bit_count() <= 4) for i in range(len(rows))]
    least = {g: min(rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None) for g in group}
    want = Counter((r[0], f"{p:016x}", least[g]) for r, p, g in zip(rows, prints, group, strict=True))
    assert Counter(map(tuple, near_duplicates(docs).collect())) == want
    assert all(text_fingerprint(r[1], 4) == p for r, p in zip(rows, prints, strict=True))


def test_near_duplicates_of_the_pipeline_are_verified(spark):
    import corpus_pipeline

    rng = random.Random(1)
    texts = []
    for n in (30, 200, 300):
        base = [f"w{rng.randrange(5000)}" for _ in range(n)]
        for changes in range(0, 16):  # similarities from 1 down to about a half
            words = list(base)
            for at in rng.sample(range(n), changes * n // 300 + changes % 2):
                words[at] = f"x{rng.randrange(5000)}"
            texts.append(" ".join(words))
    # A repeated phrase decides the fingerprint, but not the set of shingles.
    texts += ["one two three four five " * 60 + " ".join(f"{c}{i}" for i in range(40)) for c in "abc"]
    shingles = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    prints = [fingerprint(t, 5) for t in texts]
    similar = lambda i, j: 5 * len(shingles[i] & shingles[j]) >= 4 * len(shingles[i] | shingles[j])
    near = lambda i, j, radius: (prints[i] ^ prints[j]).bit_count() <= radius
    group = list(range(len(texts)))
    for _ in texts:
        group = [min(group[j] for j in range(len(texts)) if near(i, j, 10) and similar(i, j)) for i in range(len(texts))]
    ids = range(len(texts))
    assert any(near(i, j, 4) and not similar(i, j) for i in ids for j in ids) and any(similar(i, j) and near(i, j, 10) and not near(i, j, 4) for i in ids for j in ids)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.simhash_dedup(spark, table, "").collect()) == sorted(set(group))


def test_large_buckets_are_split_by_later_blocks(monkeypatch):
    monkeypatch.setattr(simhash, "DIRECT", 3)
    rng, cut = random.Random(6), simhash.blocks(10)
    assert sum(w for _, w in cut) == 64
    base = [rng.getrandbits(64) for _ in range(5)]
    fp = [b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(12)]
    agree = lambda x, y: any((x ^ y) >> s & ((1 << w) - 1) == 0 for s, w in cut[2:])
    want = {(i, j) for j in range(60) for i in range(j) if i % 7 != j % 7 and (fp[i] ^ fp[j]).bit_count() <= 10 and agree(fp[i], fp[j])}
    found = simhash.close_pairs(np.array(fp, np.uint64), np.arange(60) % 7, cut[2:], 10)
    assert {tuple(sorted(x)) for i, j in found for x in zip(i.tolist(), j.tolist(), strict=True)} == want != set()


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    found = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


def test_languages_are_learned_and_others_rejected(spark, docs):
    table = spark.createDataFrame(
        [(i, ("der und nicht ein " if i % 2 else "the and not one ") * 5, "de" if i % 2 else "en") for i in range(300)], "doc_id long, text string, lang string"
    )
    model = fit_languages(table, rows_per_language=100)
    asked = spark.createDataFrame([(1, "und der ein"), (2, "one and the"), (3, None), (4, "12 !"), (5, "今日は世界"), (6, "")], "doc_id long, text string")
    found = {r["doc_id"]: r["prediction"] for r in predict_languages(asked, model).collect()}
    assert [found[i]["lang_pred"] for i in (1, 2, 3, 4, 6)] == ["de", "en", "und", "und", "und"]
    assert [found[i]["rejected"] for i in range(1, 7)] == [False, False, True, True, True, True]
    assert all(0 <= p["score"] <= 1 for p in found.values())
    assert predict_languages(docs, fit_languages(docs)).count() == docs.count()


def test_unlearned_languages_are_rejected_by_a_large_vocabulary(spark):
    rng = random.Random(3)
    made = lambda letters, n: ["".join(rng.choices(letters, k=rng.randint(3, 9))) for _ in range(n)]
    # Related languages share letters and a part of their words; the third one is not learned.
    shared = made("abcdefghijklmnop", 600)
    words = [made("abcdefghijklmnop", 6000) + shared for _ in range(3)] + [made("qrstuvwxyzabcd", 3000)]
    prose = lambda i: " ".join(rng.choices(words[i], k=60))
    table = spark.createDataFrame([(i, prose(i % 2), "xy"[i % 2]) for i in range(1200)], "doc_id long, text string, lang string")
    model = fit_languages(table)
    assert len(np.unique(np.concatenate([subwords(r["text"]) for r in table.collect()]))) > 1 << 15  # more than there are buckets
    rejected = [sum(model.predict(prose(i))[2] for _ in range(50)) for i in range(4)]
    assert max(rejected[:2]) <= 5 and min(rejected[2:]) >= 45, rejected


def test_shards_hold_every_row_once(docs, tmp_path):
    sharded = shuffled_shards(docs, 8, bucket_bytes=4096)
    assert Counter(map(tuple, sharded.select("record.*").collect())) == Counter(map(tuple, docs.collect()))
    slots = Counter((r["shard"], r["slot"]) for r in sharded.collect())
    n = docs.count()
    assert slots == Counter((i % 8, i // 8) for i in range(n))
    clashing = docs.select("*", F.lit("own").alias("Slot"), F.lit("own").alias("shard"))
    written = tmp_path / "clashing"
    clashing.write.parquet(str(written))
    write_shards(shuffled_shards(docs.sparkSession.read.parquet(str(written)), 3, seed=1), str(tmp_path / "shards"))
    back = docs.sparkSession.read.parquet(str(tmp_path / "shards"))
    assert {(r["Slot"], r["shard"]) for r in back.collect()} == {("own", "own")}
    assert Counter((r["shard_"], r["slot_"]) for r in back.collect()) == Counter((i % 3, i // 3) for i in range(n))


def test_registered_shards_equal_brute_force(spark, docs, rows, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op3_shards(spark, str(tmp_path)).collect()
    sized = lambda t: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter((r[0], *sized(r[1])) for r in rows)
    assert {(r["law"], r["grown_shard"]) for r in found} == {("rows", None)}
    assert Counter((r["shard"], r["slot"]) for r in found) == Counter((i % 8, i // 8) for i in range(len(rows)))


@pytest.mark.parametrize("radius", [1, 2, 3, 5])
def test_links_of_any_radius_connect_what_brute_force_connects(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = {0, 31, *base}
    for x in base * 8:
        fps.add(x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 7))))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    links = near_links(spark.createDataFrame([(signed(x),) for x in fps], "fp long"), radius).collect()
    want = [(x, y) for x in fps for y in fps if x < y and (x ^ y).bit_count() <= radius]
    assert all(((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= radius for r in links)
    assert grouped(fps, want) == grouped(fps, [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in links])


def grouped(nodes, links):
    group = {x: {x} for x in nodes}
    for x, y in links:
        if group[x] is not group[y]:
            group[x] |= group[y]
            for z in group[y]:
                group[z] = group[x]
    return {frozenset(g) for g in group.values()}


def test_lines_recur_only_after_the_first(docs, rows):
    found = drop_recurring_lines(docs, min_docs=10, min_docs_long=3, long_tokens=20).collect()
    assert len(found) == len(rows)
    mail = sorted((r["row"]["doc_id"], r["text"].startswith("line ")) for r in found if (r["row"]["text"] or "").startswith("line "))
    assert [kept for _, kept in mail] == [True] + [False] * 11
    assert all(r["text"] == r["row"]["text"] for r in found if not r["n_dropped"])


def test_variable_words_are_generalised(spark):
    table = spark.createDataFrame([(i, f"user named {chr(97 + i)} has now logged in\nown {chr(97 + i)} text") for i in range(12)], "doc_id long, text string")
    found = {r["row"]["doc_id"]: r["text"] for r in drop_recurring_lines(table, depth=2).collect()}
    assert found == {i: (f"user named {chr(97)} has now logged in\n" if i == 0 else "") + f"own {chr(97 + i)} text" for i in range(12)}


def kept_lines(spark, texts):
    import corpus_pipeline

    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, table, "").collect()}


def test_a_leaf_has_several_general_templates(spark):
    name = [chr(97 + i) * 3 for i in range(12)]
    first, second = "2020-01-01 10:00 INFO user {} has logged in again today now", "2020-01-01 10:00 INFO disk {} was found full on some machine"
    texts = [f"{first.format(x)}\n{second.format(x)}\nown {x}" for x in name]
    assert kept_lines(spark, texts) == {i: texts[0] if i == 0 else f"own {x}" for i, x in enumerate(name)}


def test_long_lines_are_dropped_from_the_second_document_on(spark):
    long = " ".join(f"{c}{d}" for c in "abcde" for d in "vwxyz")
    varied = "one two three " + long.replace("av", "{}")
    texts = [f"{long}\nown x", f"{long}\nown y", f"{varied.format('p')}\nown z", f"{varied.format('q')}\nown u", "short line\nown v", "short line\nown w"]
    assert kept_lines(spark, texts) == dict(enumerate(texts)) | {1: "own y", 3: "own u"}


def test_lines_of_fields_alone_are_compared_by_their_text(spark):
    texts = [f"{i} {i * i} {i + 7}\n{i}\nhttp://x.org/{i}\n1 2 3\nmail number {i} from us" for i in range(12)]
    own = [f"{i} {i * i} {i + 7}\n{i}\nhttp://x.org/{i}" for i in range(12)]
    assert kept_lines(spark, texts) == {i: texts[0] if i == 0 else own[i] for i in range(12)}


@pytest.mark.parametrize("length, hot", [(40, 20_000), (40, 3), (400, 20_000)])
def test_repeated_bytes_equal_brute_force(docs, rows, length, hot):
    data = [(r[1] or "").encode() for r in rows]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    want = Counter()
    for r, d in zip(rows, data, strict=True):
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        want[r[0], len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    assert Counter(tuple(r)[:5] for r in repeated_bytes(docs, length, hot).collect()) == want


def test_places_of_a_very_common_window_stay_in_their_tasks(spark):
    length, n = 400, 601
    texts = [(i, i, "x" * (length + n - 1), [(n, 1, repeats.SINGLE)], 1) for i in range(8)]
    texts += [(8 + i, 8 + i, c * length, [(1, 1, repeats.SINGLE)], 1) for i, c in enumerate("yyz")]
    schema = "k1 long, k2 long, text string, marks array<struct<at:long,key:long,route:int>>, copies long"
    carriers = spark.createDataFrame(texts, schema)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = repeats._single_runs(carriers, length, 1000).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    want = [(i, i, b, b + 1) for i in range(8) for b in range(n)] + [(8, 8, 0, 1), (9, 9, 0, 1)]
    assert sorted(tuple(r)[:4] for r in found) == want
    # One window has 8 * 601 places; no task holds them all.
    assert max(Counter(r["task"] for r in found).values()) < 8 * n


def test_windows_of_one_bucket_equal_brute_force(monkeypatch):
    rng = random.Random(9)
    for mask in (1, 7, 31):
        monkeypatch.setattr(repeats, "TRIGGER_MASK", mask)
        for _ in range(20):
            base = [bytes(rng.choices(b"abc", k=150)) for _ in range(2)]
            parts = [bytearray(rng.choice(base)) for _ in range(6)] + [bytearray(b"a" * 120)]
            for p in parts:
                p[rng.randrange(len(p))] = 97
            seen = Counter(bytes(p[i : i + 50]) for p in parts for i in range(len(p) - 49))
            want = [[seen[bytes(p[i : i + 50])] > 1 for i in range(len(p) - 49)] for p in parts]
            assert [m.tolist() for m in repeats.matched_windows([bytes(p) for p in parts], 50)] == want


def test_pseudonyms_keep_format_links_and_can_be_undone(spark, docs):
    texts = ["card 4111 1111 1111 1111 or 4111111111111111, not 4111111111111112", "on 1984-02-29, +1 (212) 555-0199, at 10.0.0.1", "a.b7@x.org token = \"0123456789abcdef\"", None, ""]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hidden = pseudonymised(table, b"key")
    rows = {r["doc_id"]: r for r in hidden.collect()}
    spaced, plain, other = re.findall(r"\d[\d ]{13,}\d", rows[0]["text"])
    assert spaced.replace(" ", "") == plain != "4111111111111111" and other == "4111111111111112"
    assert [f["kind"] for f in rows[1]["pii"]] == ["date", "phone", "ip"] and [f["kind"] for f in rows[2]["pii"]] == ["email", "secret"]
    assert rows[3]["text"] is None and rows[4]["text"] == ""
    back = pseudonymised(hidden.drop("pii"), b"key", undo=True)
    assert [r["text"] for r in back.orderBy("doc_id").collect()] == texts
    assert pseudonymised(docs, b"key").count() == docs.count()
    clashing = table.withColumn("PII", F.lit("own"))
    assert pseudonymised(clashing, b"key").columns == ["doc_id", "text", "PII", "pii_"]
    repeated = pseudonymised(table.union(table), b"key").collect()
    assert Counter(r["text"] for r in repeated) == Counter([r["text"] for r in rows.values()] * 2)


def test_one_value_has_one_pseudonym_in_every_spelling_and_place():
    names, back = pseudonyms.Pseudonyms(b"k"), pseudonyms.Pseudonyms(b"k", undo=True)
    finder = re.compile("|".join(pseudonyms.PATTERNS.values()))
    hide = lambda text: pseudonyms.replaced(text, finder, finder, names)[0]
    show = lambda text: pseudonyms.replaced(text, finder, finder, back)[0]
    digits = lambda text: re.sub("[^0-9]", "", text)
    rng = random.Random(8)
    for _ in range(2000):
        payload = "".join(rng.choices("0123456789", k=15))
        card = payload + str(pseudonyms.luhn_digit(payload))
        spaced = " ".join(card[i : i + 4] for i in range(0, 16, 4))
        new, three = digits(hide(card)), "".join(rng.choices("0123456789", k=3))
        for text in (card, spaced, f"{card} {three}", f"{spaced} {three}", f"{three} {spaced}", spaced.replace(" ", "-")):
            assert new in digits(hide(text)) and len(hide(text)) == len(text), text
            assert show(hide(text)) == text
        phone = "".join(rng.choices("0123456789", k=8))
        for code in ("44", "1", "353"):
            spelled = [f"+{code}20{phone}", f"+{code} 20 {phone[:4]} {phone[4:]}", f"+{code}-20-{phone}", f"+{code} (20) {phone}"]
            assert len({digits(hide(s)) for s in spelled}) == 1 and all(hide(s).startswith("+" + code) for s in spelled)
            assert [show(hide(s)) for s in spelled] == spelled
        day = datetime.date.fromordinal(rng.randrange(datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal()))
        new = datetime.date.fromisoformat(hide(f"{day}"))
        spelled = {f"{day:%d.%m.%Y}": f"{new:%d.%m.%Y}"} | ({f"{day:%m/%d/%Y}": f"{new:%m/%d/%Y}"} if day.day > 12 else {})
        assert {s: hide(s) for s in spelled} == spelled and all(show(hide(s)) == s for s in spelled)
        for letters in ("0123456789abcdef", "0123456789ABCDEF", "0123456789abcdefABCDEF", "0123456789"):
            secret = "token=" + "".join(rng.choices(letters, k=rng.randint(12, 40)))
            assert show(hide(secret)) == secret != hide(secret)


def test_numbers_with_neighbours_are_found(spark):
    texts = ["4111 1111 1111 1111 12/27", "4111111111111111 123", "ES91 2100 0418 4502 0005 1332 FROM", "7536784127813050 4845168114407329", "123456 4111 1111 1111 1111"]
    found = pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), b"key")
    cut = {r["doc_id"]: [texts[r["doc_id"]][f["start"] : f["start"] + f["length"]] for f in r["pii"]] for r in found.collect()}
    assert cut == {0: ["4111 1111 1111 1111"], 1: ["4111111111111111"], 2: ["ES91 2100 0418 4502 0005 1332"], 3: ["7536784127813050", "4845168114407329"], 4: ["4111 1111 1111 1111"]}


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    rng = np.random.default_rng(2)
    data = [(i, rng.standard_normal(9).tolist()) for i in range(300)]
    data += [(i, data[5][1]) for i in range(300, 400)]  # a common vector
    data += [(400, None), (420, [0.0] * 9), (440, [float("nan")] * 9), (460, [1.0, None]), (480, [float("inf")]), (500, [1.0, 2.0]), (None, [1.0] * 9), data[0]]
    path = str(tmp_path_factory.mktemp("vectors") / "e.parquet")
    spark.createDataFrame(data, "vec_id long, embedding array<double>").write.parquet(path)
    kept = [(i, np.array(v + [0.0] * (9 - len(v)))) for i, v in data if i is not None and v and None not in v and np.isfinite(v).all()]
    return spark.read.parquet(path), kept


def best(kept, k, every, scale):
    want = {}
    for q, x in {i: v for i, v in kept if i % every == 0}.items():
        whole = (lambda v: np.floor(1024 * v)) if scale else (lambda v: v)
        want[q] = sorted((-float((whole(v) * whole(x)).sum()), i) for i, v in kept if i != q)[:k]
    return want


def test_exact_search_equals_brute_force(vectors):
    table, kept = vectors
    found = exact_top_k(table, F.col("vec_id") % 100 == 0, 10, pivots=5, block_rows=64, block_queries=2).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((-float(r["score"]), r["vec_id"]))
    assert got == best(kept, 10, 100, True)
    assert exact_top_k(table.where("false"), F.col("vec_id") % 100 == 0, 10).count() == 0


def test_adaptive_search_finds_most(vectors):
    table, kept = vectors
    kept = [(i, v) for i, v in kept if v.any()]
    found = approximate_top_k(table, F.col("vec_id") % 20 == 0, 20, list_rows=40, group_rows=100, chunk_rows=64, part_queries=4).collect()
    want, got = best(kept, 20, 20, False), {}
    for r in found:
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    assert set(got) == set(want) and all(sorted(x) == list(range(1, 21)) for x in got.values())
    hits = sum(len(set(got[q].values()) & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * sum(len({i for _, i in x}) for x in want.values())
    assert approximate_top_k(table.where("false"), F.col("vec_id") % 20 == 0, 20).count() == 0


def test_mix_comes_near_its_targets(docs, rows):
    found = mix_sources(docs).collect()
    assert len(found) == len(rows) and found == mix_sources(docs).collect() or Counter(found) == Counter(mix_sources(docs).collect())
    for target in {(r["source_size"], r["target"]) for r in found}:
        own = [r for r in found if (r["source_size"], r["target"]) == target]
        assert abs(sum(r["size"] * r["copies"] for r in own) - target[1]) <= max(r["size"] for r in own)
    assert max(r["copies"] for r in found) <= 3
    assert sum(r["copies"] for r in found) == mixed_documents(docs).count()
    assert mixed_documents(docs).columns == docs.columns


def test_packing_is_whole_and_tight(docs, rows):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer())
    found = pack_documents(docs, tokenizer(), max_tokens=64, group_pieces=50).collect()
    want = Counter()
    for r in rows:
        ids = np.array(whole.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4")
        for n, at in enumerate(range(0, len(ids), 64)):
            want[r[0], n, at, len(ids[at : at + 64]), zlib.crc32(ids[at : at + 64].tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in found) == want
    by_sequence = {}
    for r in sorted(found, key=lambda r: r["offset"]):
        assert by_sequence.get(r["sequence_id"], 0) == r["offset"]
        by_sequence[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(by_sequence.values()) <= 64


def test_best_fit_takes_the_tightest_bin():
    bins, offsets = best_fit_decreasing(np.array([7, 5, 3, 2, 2, 1]), 10)
    assert bins.tolist() == [0, 1, 0, 1, 1, 1] and offsets.tolist() == [0, 0, 7, 5, 7, 9]


def test_words_are_tokenised_as_in_their_text():
    from tokenizers import Tokenizer

    path, rng = tokenizer(), random.Random(0)
    words, whole = WordIds(path), Tokenizer.from_file(path)
    texts = ["a<|endoftext|>b <|ENDOFTEXT|>", "don't 'tis b!!! É é", "İ. x"] + ["".join(rng.choices("aBcÉ'’.,!<|> \t\n1２éßΣİ漢 \x85", k=30)) for _ in range(500)]
    assert all(np.frombuffer(words.encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids for t in texts)


def test_empty_tables_give_empty_results(empty):
    assert near_duplicates(empty).count() == 0
    assert predict_languages(empty, fit_languages(empty)).count() == 0
    assert shuffled_shards(empty, 8).count() == 0
    assert drop_recurring_lines(empty).count() == 0
    assert repeated_bytes(empty).count() == 0
    assert pseudonymised(empty, b"k").count() == 0
    assert mix_sources(empty).count() == 0
    assert pack_documents(empty, tokenizer()).count() == 0


def test_pipeline_stages_keep_columns_and_one_of_each_group(spark, docs, tmp_path):
    import corpus_pipeline

    table, names = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, table, "").write.parquet(str(tmp_path / name))
        table = spark.read.parquet(str(tmp_path / name))
        if name != "pack":
            assert table.columns == names
    deduped = spark.read.parquet(str(tmp_path / "simhash_dedup"))
    prints = [text_fingerprint(r["text"], 5) for r in deduped.collect()]
    assert prints and len(set(prints)) == len(prints)
