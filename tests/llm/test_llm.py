"""Each text operator against brute force on small tables, with nulls, empty and repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import compression_classifier as zip_, exact_dedup, jaccard_join, license_scan, mixing, piece_transducer as pt
from tidemark.llm import quality_rules, revisits, secret_scan, wrapper_extract
from tidemark.llm.queries import QUERIES, piece_model

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def some_texts():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(vocabulary, k=60)) for _ in range(6)]
    texts = [None, "", " \n\t ", "one two", "ONE two", "a b c d e f g h i j k"]
    texts += [b for b in base for _ in range(3)]
    texts += [b.replace("w1", "changed", 1) for b in base] + [base[0].upper(), base[1].replace(" ", "\n"), "x " * 4000, "y" * 5000]
    texts += ["same line of words\n" * 5 + "tail # * $ %"] * 2
    return texts


@pytest.fixture
def docs(spark):
    texts = some_texts()
    rows = [(i if i != 7 else None, t, "en", [None, "a", "b", "ä", ""][i % 5], None) for i, t in enumerate(texts)]
    rows.append(rows[8])
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def squeeze(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_quality_measures_and_scores(spark, docs, nothing):
    trusted = spark.createDataFrame([(9,), (9,), (None,), (999,)], "doc_id long")
    got = quality_rules.quality_rules(docs.withColumn("KEPT", F.lit("clash")), trusted).collect()
    assert len(got) == docs.count()
    for r in got:
        words = WORDS.findall(r["text"] or "")
        grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in (r["text"] or "").split("\n") if WORDS.search(x)]
        assert (r["n_words"], r["word_chars"]) == (len(words), sum(map(len, words)))
        assert r["n_repeat_words"] == len(covered) and r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", r["text"] or ""))
        assert r["base_failed"] == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
        assert not (r["base_failed"] and r["kept"]) and (r["score"] is None) == (not words)
    assert quality_rules.quality_rules(nothing, trusted).count() == 0


def test_quality_score_against_brute_force(spark, docs):
    trusted_ids = {9, 12, 20, 24}
    rows, n = docs.collect(), 50

    def part(doc_id):
        return 0 if doc_id is None else int(hashlib.md5(str(doc_id).encode()).hexdigest()[0], 16)

    def buckets(text):
        codes = [zlib.crc32(w.encode()) for w in WORDS.findall(text or "")]
        return [c % n for c in codes] + [(a * quality_rules.PAIR + b) % n for a, b in zip(codes, codes[1:])]

    def weights(fold):
        t, r = Counter(), Counter()
        for row in rows:
            if part(row["doc_id"]) != fold:
                r.update(buckets(row["text"]))
                t.update(buckets(row["text"]) if row["doc_id"] in trusted_ids else ())
        rate = sum(t.values()) / sum(r.values())
        return [math.log((t[b] + quality_rules.SMOOTH) / (r[b] * rate + quality_rules.SMOOTH)) for b in range(n)]

    by_fold = {f: weights(f) for f in {part(r["doc_id"]) for r in rows}}
    trusted = spark.createDataFrame([(i,) for i in trusted_ids], "doc_id long")
    judged = quality_rules.quality_rules(docs, trusted, buckets=n, min_score=-0.01).collect()
    assert len({r["kept"] for r in judged if not r["base_failed"]}) == 2
    for r in judged:
        found = [by_fold[part(r["doc_id"])][b] for b in buckets(r["text"])]
        assert r["n_grams"] == len(found)
        if found:
            mean = sum(found) / len(found)
            assert abs(r["score"] - mean) < 2e-6
            assert abs(mean + 0.01) < 2e-6 or r["kept"] == (not r["base_failed"] and mean >= -0.01)


def test_quality_verdict_agrees_with_labels(spark):
    folder = "/root/testdata/sf0.01"
    judged = QUERIES["op1_quality_rules"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    n = {(r["quality"], r["kept"]): r["count"] for r in judged.where("NOT base_failed").groupBy("quality", "kept").count().collect()}
    assert n[0, True] <= 0.1 * (n[0, True] + n[0, False])
    assert n[1, False] < 0.01 * (n[1, True] + n[1, False])


def test_exact_dedup(docs, nothing):
    rows = docs.collect()
    groups = {}
    for r in rows:
        groups.setdefault(squeeze(r["text"]), []).append(r)
    for salts in (1, 64):
        got = exact_dedup.exact_groups(docs, salts=salts).collect()
        assert len(got) == len(rows) and sum(g["kept"] for g in got) == len(groups)
        by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
        for g in got:
            members = by_sha[g["text_sha256"]]
            best = min(members, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))
            assert g["group_size"] == len(members) and g["keep_id"] == best["doc_id"]
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_groups(nothing).count() == 0 and exact_dedup.exact_dedup(nothing).count() == 0


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        target = {s: 3 * sizes[s] if s in full else left * weight[s] / sum(weight[x] for x in free) for s in order}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def test_mixing(docs, nothing):
    plan = mixing.mix_plan(docs.withColumn("SIZE", F.lit("clash")), blocks=8, shards=5).collect()
    assert len(plan) == docs.count()
    sizes = Counter()
    for r in plan:
        assert r["size"] == len(WORDS.findall(r["text"] or "")) and len(r["draws"]) <= 3
        sizes[r["source"]] += r["size"]
    targets = brute_targets(sizes)
    taken, largest = Counter(), max(r["size"] for r in plan)
    for r in plan:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]])
        taken[r["source"]] += r["size"] * len(r["draws"])
    assert all(abs(taken[s] - targets[s]) <= largest for s in sizes)
    again = mixing.mix_plan(docs.repartition(3), blocks=8, shards=5).collect()
    assert sorted((str(r["doc_id"]), r["size"], str(r["draws"])) for r in again) == sorted((str(r["doc_id"]), r["size"], str(r["draws"])) for r in plan)
    rows = mixing.mixed(docs, blocks=8, shards=5)
    assert rows.columns == docs.columns and rows.count() == sum(len(r["draws"]) for r in plan)
    assert mixing.mix_plan(nothing).count() == 0 and mixing.mixed(nothing).count() == 0


def test_splitting_tree_is_exact(spark):
    quotas = spark.createDataFrame([("sa", 700), ("sb", 1), ("sc", 40)], "__key string, n long")
    leaves = mixing.shard_quotas(quotas, shards=7).collect()
    assert {k: sum(r["n"] for r in leaves if r["__key"] == k) for k in ("sa", "sb", "sc")} == {"sa": 700, "sb": 1, "sc": 40}
    assert all(r["n"] >= 0 for r in leaves)
    by_shard = Counter()
    for r in leaves:
        by_shard[r["shard"]] += r["n"]
    assert max(by_shard.values()) - min(by_shard.values()) <= 2


def test_hypergeometric_draws(spark):
    pool, marked, take, n = 30, 12, 10, 4000
    draw = mixing.hypergeometric(str(pool), str(marked), str(take), f"id / {n}D")
    got = Counter(r[0] for r in spark.range(n).select(F.expr(draw)).collect())
    for k in range(0, 11):
        p = math.comb(marked, k) * math.comb(pool - marked, take - k) / math.comb(pool, take)
        assert abs(got[k] / n - p) < 2 / n + 1e-9


def test_encoding_matches_the_library(spark, docs, nothing):
    import sentencepiece

    model = piece_model()
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    got = pt.encode_texts(docs, model).collect()
    by_row = sorted((str(r["doc_id"]), tuple(r["ids"])) for r in got)
    assert by_row == sorted((str(r["doc_id"]), tuple(library.encode(r["text"] or ""))) for r in docs.collect())
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in got)
    machine, rng = pt.Transducer(model), random.Random(5)
    for _ in range(2000):
        text = "".join(rng.choice("ab  \n\té😀▁thein.,<>01 中") for _ in range(rng.randint(0, 25)))
        assert machine.encode(text) == library.encode(text) and machine.decode(machine.encode(text)) == library.decode(library.encode(text))
    texts = {r["doc_id"]: r["text"] for r in pt.decode_ids(pt.encode_texts(docs.where("doc_id > 8"), model), model).collect()}
    assert all(texts[r["doc_id"]] == r["text"] for r in docs.where("doc_id > 8").collect())
    assert pt.encode_texts(nothing, model).count() == 0


def test_a_word_is_searched_once_whatever_follows_it(monkeypatch):
    machine, searched = pt.Transducer(piece_model()), []
    search = machine.shortest_path
    monkeypatch.setattr(machine, "shortest_path", lambda cut: searched.append(cut) or search(cut))
    ends = [c for c in "!?$;:§~^" if "r" + c not in machine.neighbours]
    text = " ".join(["onwhor", *(f"onwhor{c}" for c in ends)] * 2)
    assert len(ends) > 2 and machine.decode(machine.encode(text)) == text
    assert searched.count("▁onwhor") == 1 and len(searched) <= 1 + len(ends)


def test_cuts_still_in_use_are_kept_when_the_memory_is_full(monkeypatch):
    monkeypatch.setattr(pt, "REMEMBERED", 20)
    machine, other, searched = pt.Transducer(piece_model()), pt.Transducer(piece_model()), []
    search = machine.shortest_path
    monkeypatch.setattr(machine, "shortest_path", lambda cut: searched.append(cut) or search(cut))
    for k in range(100):
        assert machine.encode(f"onwhor w{k}") == other.encode(f"onwhor w{k}")
    assert searched.count("▁onwhor") == 1 and len(machine.by_cut) + len(machine.older) <= 40


def test_decoding_bytes_between_pieces():
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("▁", -1.0, 1), ("a", -2.0, 1), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256))]
    machine = pt.Transducer.of(pieces, pt.MERGES)
    byte = {b: 4 + b for b in range(256)}
    assert machine.decode([2, 3, byte[0xC3], byte[0xA9], 3]) == "aéa"
    assert machine.decode([2, byte[0xC3], 3, byte[0xA9], byte[0x0A]]) == "\ufffda\ufffd\n"
    assert machine.decode([2, byte[0xC3], 1, byte[0xA9], 0]) == "\ufffd\ufffd ⁇ "


def test_unigram_shortest_path_is_the_best_of_all():
    pieces = [("<unk>", 0.0, 2), ("▁a", -1.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -2.2, 1), ("▁", -1.5, 1), ("ba", -2.1, 1)]
    machine = pt.Transducer.of(pieces, pt.UNIGRAM)
    score = {p: s for p, s, t in pieces if t == 1}

    def best(text):
        if not text:
            return 0.0
        return max((score[text[:k]] + best(text[k:]) for k in range(1, len(text) + 1) if text[:k] in score), default=-math.inf)

    for text in ("abab", "ba", "aabba b", "b"):
        ids = machine.encode(text)
        assert sum(machine.scores[i] for i in ids) == pytest.approx(best(machine.normalised(text)))


def test_main_text(spark):
    def page(body):
        return f"<html><head><title>t</title></head><body><nav><a>menu</a></nav>{body}<footer>foot</footer></body></html>"

    article = '<article><h1>Head {0}</h1><p>One <b>b</b>old &amp; {0}<br>more<p>Same line.<div class="comments"><p>no</p></div><form>f</form></article>'
    rows = [(i, f"http://h.example/{i}", page(article.format(i))) for i in range(5)]
    rows += [(10 + i, f"http://g.example/{i}", page(f"<div>Banner text</div><div><p>Story {i}</p><p>of day {i * 7}</p></div>")) for i in range(5)]
    rows += [(20, None, "<p>no host"), (21, "http://h.example/x", None), (22, "http://h.example/y", ""), (0, rows[0][1], rows[0][2])]
    got = wrapper_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    texts = {r["page_id"]: r["text"] for r in got}
    assert all(texts[i] == f"Head {i} One bold & {i} more Same line." for i in range(5))
    assert all(texts[10 + i] == f"Story {i} of day {i * 7}" for i in range(5))  # the banner is the same everywhere
    assert (texts[20], texts[21], texts[22]) == ("no host", "", "")
    assert wrapper_extract.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_main_text_is_aligned_around_articles(spark):
    def teaser(i):
        cards = "".join(f"<article><h2>Card {k}</h2></article>" for k in range(3))
        return f"<body><div class='top'>Our daily paper</div><div class='text'><p>Long unmarked story number {i} goes on and on and on for a while</p></div>{cards}</body>"

    def repeated(i):
        return f"<article><h1>Title {i}</h1><div><p>Story {i} of the day is told here at some length</p></div><section><p>Write to us</p></section></article>"

    rows = [(i, f"http://h.example/{i}", teaser(i)) for i in range(5)] + [(10 + i, f"http://g.example/{i}", repeated(i)) for i in range(5)]
    got = wrapper_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    texts = {r["page_id"]: r["text"] for r in got}
    assert all(texts[i] == f"Long unmarked story number {i} goes on and on and on for a while" for i in range(5))
    assert all(texts[10 + i] == f"Title {i} Story {i} of the day is told here at some length" for i in range(5))


def test_main_text_beside_groups_of_copies(spark):
    def page(story, extra=""):
        return f"<div class='top'>Our daily paper{extra}</div><div class='text'><p>{story}</p></div>"

    same = "One long story that was published again and again under a lot of addresses of the host"
    rows = [(i, f"http://h.example/{i}", page(same, "<br>" * (i % 3))) for i in range(40)]
    rows += [(100 + i, f"http://h.example/s{i}", page(f"Story number {i} is long enough to be told apart from the others")) for i in range(4)]
    rows += [(200 + i, f"http://h.example/l{i}", f"<ul class='links'><li>Contents</li></ul><h2>List {i} of the archive of this paper</h2>") for i in range(4)]
    got = wrapper_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    texts = {r["page_id"]: r["text"] for r in got}
    assert len(texts) == len(rows) and all(texts[i] == same for i in range(40))
    assert all(texts[100 + i] == f"Story number {i} is long enough to be told apart from the others" for i in range(4))
    assert all(texts[200 + i] == f"List {i} of the archive of this paper" for i in range(4))


def test_main_text_of_a_host_with_many_layouts(spark):
    def page(kind, i):
        return f"<div class='lay{kind}'><div class='top{kind}'>Our daily {kind}</div><div class='text{kind}'><p>Story {i} of kind {kind} goes on and on for a long while</p></div></div>"

    kinds = "abcdefghijkl"
    rows = [(10 * n + i, f"http://h.example/{kind}{i}", page(kind, i)) for n, kind in enumerate(kinds) for i in range(4)]
    rows += [(1000 + i, f"http://g.example/{i}", page("z", i)) for i in range(4)] + [(2000, None, page("y", 0)), (2001, "http://h.example/none", None)]
    got = wrapper_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    texts = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows)
    assert all(texts[10 * n + i] == f"Story {i} of kind {kind} goes on and on for a long while" for n, kind in enumerate(kinds) for i in range(4))
    assert all(texts[1000 + i] == f"Story {i} of kind z goes on and on for a long while" for i in range(4))
    assert texts[2000].startswith("Our daily y") and texts[2001] == ""


def test_main_text_of_wrappers_and_deep_pages():
    text = "The whole story of the day, told in one long line of words."
    for wrapper in ("div class='content has-sidebar'", "div id='share-page'", "div class='post related-x'", "div class='sidebar'", "form"):
        html = f"<body class='header-fixed no-comments'><{wrapper}><p>{text}</p><div class='page-footer'>foot</div></{wrapper.split()[0]}></body>"
        assert wrapper_extract.extract(html, []) == text
    beside = f"<main class='menu'><p>{text}</p></main><div class='sidebar'><p>{text * 3}</p></div>"
    assert wrapper_extract.extract(beside, []) == text
    deep = [wrapper_extract.outline(wrapper_extract.Page("<div>" * 5000 + f"notice<div>{text} {i}").root) for i in range(4)]
    deep = [wrapper_extract.unpacked(wrapper_extract.packed(o)) for o in deep]
    assert wrapper_extract.extract("<div>" * 5000 + f"notice<div>{text} 0", deep[1:]) == f"{text} 0"


def test_jaccard_components(docs, nothing):
    rows = docs.collect()

    def shingles(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [shingles(r["text"]) for r in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    want = []
    for i, r in enumerate(rows):
        ids = [rows[j]["doc_id"] for j in range(len(rows)) if label[j] == label[i] and rows[j]["doc_id"] is not None]
        want.append((str(r["doc_id"]), len(sets[i]), min(ids) if sets[i] and ids else r["doc_id"]))
    got = [(str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_the_rest_of_a_tile_gives_each_pair_once(spark, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(jaccard_join, "ROUNDS", 1)
    monkeypatch.setattr(jaccard_join, "LEADERS", 1)
    common = " ".join(f"c{k}" for k in range(30))
    texts = []
    for g in range(6):  # groups of near copies, some too far apart, that all share a passage
        words = [f"g{g}w{rng.randrange(10**6)}" for _ in range(60 + 8 * g)]
        for _ in range(14):
            own = list(words)
            for k in rng.sample(range(len(own)), rng.randint(0, 3)):
                own[k] = f"x{rng.randrange(10**9)}"
            texts.append(" ".join(own) + " " + common)
    seen = []
    rest = jaccard_join._rest
    monkeypatch.setattr(jaccard_join, "_rest", lambda tiles: seen.append((tiles, rest(tiles))) or seen[-1][1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs).collect()}
    tiles, pairs = seen[0]
    sets = {jaccard_join.node_of(s): set(s.tolist()) for s in map(jaccard_join.shingles, texts)}
    label = {r["node"]: r["label"] for r in tiles.collect()}
    linked = {frozenset((a, b)) for a in sets for b in sets if a != b and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])}
    found = [frozenset(r) for r in pairs.collect()]
    assert len(found) == len(set(found)) and all(len(sets[x]) <= len(sets[y]) for x, y in pairs.collect())
    assert {p for p in linked if len({label.get(x, x) for x in p}) == 2} <= set(found)
    assert len(found) < 3 * len(linked)
    nodes = [jaccard_join.node_of(jaccard_join.shingles(t)) for t in texts]
    want = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(nodes):
            for j, b in enumerate(nodes):
                if a == b or frozenset((a, b)) in linked:
                    want[i] = want[j] = min(want[i], want[j])
    assert got == dict(enumerate(want))


def test_tile_rows_without_a_possible_partner_are_left_out(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(rng.randrange(12), node, n, rng.randrange(jaccard_join.prefix_length(n))) for node, n in enumerate(rng.choices(range(1, 90), k=120))]
    rows += [(100 + k // 2, 500 + k, n, rng.randrange(jaccard_join.prefix_length(n))) for k, n in enumerate(rng.choices(range(20, 40), k=120))]
    got = {r["node"]: r["room"] for r in jaccard_join._with_room(spark.createDataFrame(rows, "shingle long, node long, n int, place int")).collect()}
    may = {x: any(s == t and x != y and 7 * min(n - p, m - q) >= 3 * (n + m) for t, y, m, q in rows) for s, x, n, p in rows}
    assert all(got[x] for x in may if may[x]) and {True, False} == {may[x] for x in may if x >= 500}
    assert all(got[x] == may[x] for x in may if x >= 500)  # tiles of two rows
    # passages of short texts make up long ones: all shingles are shared, but only one pair can link
    shorts = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(60)) for _ in range(15)]
    texts = [*shorts, shorts[0] + " more", *[" ".join(shorts[k : k + 5]) for k in (0, 5, 10)]]
    kept, written = {}, jaccard_join.written
    monkeypatch.setattr(jaccard_join, "written", lambda df, name: kept.setdefault(name, written(df, name)) if name in ("jaccard-sets", "jaccard-texts") else written(df, name))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs).collect()}
    assert found == {k: 0 if k == 15 else k for k in range(len(texts))}
    assert {r["id"] for r in kept["jaccard-sets"].collect()} == {0, 15} and kept["jaccard-texts"].count() == 2


def test_jaccard_on_nothing(nothing):
    kept = jaccard_join.near_dedup(nothing)
    assert kept.columns == nothing.columns and kept.count() == 0


def test_revisits(spark, nothing):
    url = "HTTPS://A.example:443/p?b=2&a=1#x"
    same = "http://a.example/p?a=1&b=2"
    rows = [
        (1, url, 10, False, '"v1"', "m1", "d1", {"etag": '"v1"', "content-type": "text/html", "date": "1"}),
        (2, same, 20, True, '"v1"', None, None, {"date": "2", "content-type": "no", "expires": "9"}),
        (3, same, 9000, False, '"v2"', "m2", "d2", None),
        (4, same, 90000, True, '"v1"', "m2", None, None),
        (5, same, 95000, True, None, "m2", None, {"date": "5"}),
        (6, "http://b.example", 5, True, '"v1"', None, None, None),
        (7, None, 5, True, '"v1"', None, None, None),
        (8, same, 10, True, '"v1"', None, None, None),
    ]
    frame = spark.createDataFrame(rows, "record_id long, url string, time long, revisit boolean, etag string, last_modified string, digest string, headers map<string,string>")
    got = {r["record_id"]: r for r in revisits.resolve_revisits(frame.withColumn("sent", F.lit(1))).collect()}
    assert {k: (r["source_id"], r["outcome"]) for k, r in got.items()} == {
        2: (1, "resolved"), 4: (3, "mismatch"), 5: (3, "resolved"), 6: (None, "no_earlier"), 7: (None, "no_url"), 8: (1, "resolved")
    }
    assert got[2]["headers"] == {"etag": '"v1"', "content-type": "text/html", "date": "2", "expires": "9"} and got[2]["digest"] == "d1"
    assert revisits.resolve_revisits(frame.where("false")).count() == 0


def test_licenses(spark, docs, nothing):
    texts = ["Intro.\nReleased under the MIT License.\nEnd.", license_scan.TEMPLATES[2][1].replace(" to use, ", "\nto use, "), "nothing here", None, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r["doc_id"], r["unit"], r["place"], r["license"], r["dice"]) for r in license_scan.license_scan(frame).collect()]
    assert (0, "line", 1, "MIT", 1.0) in got and {g[0] for g in got} == {0, 1}
    assert (1, "paragraph", 0, "MIT", 1.0) in got
    assert license_scan.license_scan(docs).count() == 0 and license_scan.license_scan(nothing).count() == 0
    for m in range(1, 60):  # sizes outside the bounds cannot reach the coefficient
        allowed = license_scan.sizes_allowed(m)
        assert all((2 * min(n, m) / (n + m) >= license_scan.MIN_DICE - 1e-9) == (n in allowed) for n in range(1, 200))


def test_compression_classifier(spark, nothing):
    rng = random.Random(2)
    good = [" ".join(rng.choices(["river", "stone", "walks", "under", "the", "quiet", "light"], k=60)) for _ in range(120)]
    bad = [" | ".join(rng.choices(["BUY!!", "$$$", "click", "%%%", "win###"], k=60)) for _ in range(120)]
    rows = [(i, t, None, None, None) for i, t in enumerate(good + bad)] + [(900, None, None, None, None), (901, "", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(240)] + [(None, 1, 0), (0, None, 0)], "doc_id long, quality int, toxic int")
    model = zip_.train(*zip_.labelled_sample(docs, labels))
    got = {r["doc_id"]: r["score"] for r in zip_.quality_scores(docs, model).collect()}
    held = [r["doc_id"] for r in docs.where(zip_.fold("doc_id") == zip_.HELD_OUT).collect() if r["doc_id"] < 240]
    assert sum((got[i] >= zip_.THRESHOLD) == (i < 120) for i in held) >= 0.95 * len(held)
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values()) and got[900] == got[901]
    assert zip_.quality_scores(nothing, model).count() == 0
    assert 0 <= zip_.Model(zip_.dictionary([]), zip_.dictionary([])).score((0.0, 1.0)) <= 1


def test_compression_classifier_reads_whole_texts(spark):
    late = "z" * 40_000 + "".join(f"the late part {i} " for i in range(4000))
    assert any(b"late part" in p for p in zip_.pieces(late)) and len(zip_.pieces(late)) == zip_.PIECES
    docs = spark.createDataFrame([(i, late, None, None, None) for i in range(40)], DOCS)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    sample, _ = zip_.labelled_sample(docs, labels)
    assert sample.count() > 0 and all(r["text"] == late for r in sample.collect())


def test_secret_scan(spark, nothing):
    rng = random.Random(4)
    keys = ["".join(rng.choices("0123456789abcdef", k=40)) for _ in range(60)]
    texts = [f"é Token = '{k}' rest" for k in keys] + [None, "", "secret=token: abcdefghijklmn", "password: short", "key AKIA" + "A1" * 8, "plain words only"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])]
    found = secret_scan.secret_scan(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in secret_scan.digest(found).collect()}
    assert found.count() == len(rows)
    start = texts[0].index("Token")
    spans = f"assign:{start}:{texts[0].index(keys[0]) + 40},hex:{texts[0].index(keys[0])}:{texts[0].index(keys[0]) + 40}"
    assert got[0]["spans"] == spans and got[0]["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
    n = len(keys)
    assert [got[n + i]["spans"] for i in (0, 1, 2, 3, 5)] == [""] * 5 and got[n + 4]["n_access"] == 1
    automata = secret_scan.infer({"hex": keys})
    assert len({t for s in automata["hex"].next for t in s.values()}) < len(automata["hex"].next)  # states were merged
    assert automata["hex"].log_likelihood(keys[0]) > automata["hex"].log_likelihood("theriverwalksunderquietstones")
    assert secret_scan.secret_scan(nothing).count() == 0


ALPHABETS = {
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base36": "abcdefghijklmnopqrstuvwxyz0123456789",
}


@pytest.mark.parametrize("name", list(ALPHABETS))
def test_secret_scan_adds_unassigned_tokens(spark, name):
    rng = random.Random(8)
    token = lambda: "".join(rng.choices(ALPHABETS[name], k=40))
    prose = "The international organisations communicate (extraordinarily) IMPORTANTINFORMATION on 20240131123059 ================ and "
    rows = [(i, prose + f"token: {token()} end") for i in range(150)]
    planted = [token() for _ in range(40)]
    rows += [(1000 + i, prose + f"then {t} follows") for i, t in enumerate(planted)]
    found = secret_scan.secret_scan(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: [(s["start"], s["end"], s["kind"]) for s in r["spans"]] for r in found.collect()}
    at = len(prose) + len("then ")
    assert all(got[1000 + i] == [(at, at + 40, "like_assign")] for i in range(40))
    assert all([k for _, _, k in got[i]] == ["assign"] for i in range(150))


def test_secret_scan_scores_every_run(spark):
    rng = random.Random(9)
    token = lambda k, letters=ALPHABETS["base62"]: "".join(rng.choices(letters, k=k))
    prose = "International organisations communicate extraordinarily. They see www.example.org/some-page.html and/or more, "
    rows = [(i, prose + f"token: {token(40)}.{token(20)} end") for i in range(150)]
    planted = {
        "letters": "".join(a + b for a, b in zip(token(16, ALPHABETS["base62"][:26]), token(16, ALPHABETS["base62"][26:52]))),
        "short": token(6) + "7Qx" + token(5),
        "dotted": f"{token(10)}.{token(30)}.{token(14)}",
        "around hex": f"{token(20)}Z{token(20, '0123456789abcdef')}Z{token(20)}",
    }
    rows += [(1000 + i, prose + f"then {t} follows") for i, t in enumerate(planted.values())]
    value = token(30)
    rows.append((2000, f"see my_secret={value} there"))
    found = secret_scan.secret_scan(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: [(s["start"], s["end"], s["kind"]) for s in r["spans"]] for r in found.collect()}
    at = len(prose) + len("then ")
    for i, t in enumerate(planted.values()):
        assert (at, at + len(t), "like_assign") in got[1000 + i] and sum(k.startswith("like") for _, _, k in got[1000 + i]) == 1
    assert [k for _, _, k in got[1003]] == ["like_assign", "hex"]
    assert got[2000] == [(7, 14 + len(value), "assign")]
    assert all([k for _, _, k in got[i]] == ["assign"] for i in range(150))


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, sf)
    assert got.count() > 0 and got.where("not round_trip").count() == 0


def test_shingle_sets_over_blocks(monkeypatch):
    import itertools
    import random

    import numpy as np
    import pyarrow as pa

    def plain(text):
        found = [bytes(w) for w in (text or "").encode().lower().split()]
        size = min(5, len(found))
        return {tuple(found[i : i + size]) for i in range(len(found) - size + 1)} if found else set()

    rnd = random.Random(7)
    for block in (7, 20, 64):
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        for _ in range(60):
            texts = [rnd.choice([None, "".join(rnd.choices("aBbé \t\n z", k=rnd.choice([0, 1, 9, 40, 120])))]) for _ in range(rnd.randint(0, 9))]
            got = jaccard_join.shingle_sets(pa.array([None, *texts], pa.string()).slice(1))
            sets = [plain(t) for t in texts]
            assert [len(s) for s in got] == [len(s) for s in sets]
            for i, k in itertools.product(range(len(texts)), repeat=2):
                assert len(np.intersect1d(got[i], got[k])) == len(sets[i] & sets[k])


def linked_groups(rows):
    """Groups of row numbers that the links of their five-word sets join; rows without words are alone."""
    sets = []
    for _, text in rows:
        ws = WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} or ({tuple(ws)} if ws else set()))
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    return group


def test_near_dedup_keeps_one_row_of_each_group_by_text(spark, docs):
    rng = random.Random(8)
    prose = [" ".join(rng.choices([f"v{i}" for i in range(500)], k=40)) for _ in range(6)]
    rows = [(None, prose[0]), (None, prose[1]), (5, prose[2]), (5, prose[3]), (None, "null"), (6, None), (6, None), (7, prose[2] + " tail"), (9, prose[4]), (8, prose[4])]
    rows += [(None, prose[5]), (None, prose[5])]
    rows += [(r["doc_id"], r["text"]) for r in docs.collect()]
    frame = spark.createDataFrame([(i, t, "a", "b", 1) for i, t in rows], "doc_id long, text string, own string, __key string, n int")
    kept = jaccard_join.near_dedup(frame)
    assert kept.columns == frame.columns
    group = linked_groups(rows)
    want = []
    for g in sorted(set(group)):
        members = [rows[k] for k in range(len(rows)) if group[k] == g]
        best = min((m[0] is None, m[0] or 0) for m in members)
        want.append((None if best[0] else best[1], {m[1] for m in members}))
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    assert len(got) == len(want)
    for g in want:  # each group gives one row, of its smallest identifier
        mine = [r for r in got if r[1] in g[1] and r[0] == g[0]]
        assert mine, g
    string_ids = frame.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    assert jaccard_join.near_dedup(string_ids).count() == len(want)


def test_stages_leave_the_columns_as_they_are(spark, docs):
    clashing = docs.withColumns({c: F.lit(c) for c in ("size", "__key", "__n", "__sha", "row", "key", "n", "draws", "id", "own")})
    for stage in (mixing.mixed, exact_dedup.exact_dedup, jaccard_join.near_dedup):
        got = stage(clashing)
        assert got.columns == clashing.columns
        rows = got.collect()
        assert rows and all(r[c] == c for r in rows for c in ("size", "__key", "__n", "__sha", "row", "key", "n", "draws", "id", "own"))
    assert sorted(map(repr, mixing.mixed(docs).collect())) == sorted(map(repr, mixing.mixed(clashing).select(*docs.columns).collect()))
