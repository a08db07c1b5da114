import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tallybrook.llm import bpe_transducer, brown_lm, license_scan, line_dedup, near_dup, packing, pretokens, quality_classifier, quality_rules, queries, token_counts, topk_search
from tallybrook.llm.common import lookup_join, saved, settled, tokenizer_path, with_row_id

WORD = re.compile("[^\x20\x09-\x0d]+")
PASSAGE = " ".join(f"word{i}" for i in range(60))
TEXTS = [
    None, "", "   \n\t\n", "one", "Tie tie tie", PASSAGE, PASSAGE, f"before it\n{PASSAGE}\nafter it", "x" * 3000, ("ab cd " * 4000).strip(),
    "naïve café\x85 \xa0 end\x1c!", "日本語 text 🙂 <|endoftext|> more", "Released under the MIT License.", "a\n\n\nb\n", "the same words " * 8,
    " ".join(f"w{i}" for i in range(100)), " ".join(f"w{i}" for i in range(100)).replace("w50", "other"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 2}", None if t is None else len(t), i) for i, t in enumerate(TEXTS)]
    rows += [(5, PASSAGE, "en", "src0", 1, 9), (None, "no id here", None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score long"
    clashing = spark.createDataFrame(rows, schema).withColumns({"row": F.lit(1), "n_tokens": F.lit("x"), "kept": F.lit(0), "n_lines": F.lit(3)})
    return saved(clashing, "docs")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(3, 14)] + [(None, 1, 0), (6, None, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")


def all_results(docs, labels):
    return {
        "license": license_scan.license_scan(docs), "classifier": quality_classifier.classify(docs, labels), "rules": quality_rules.quality_rules(docs),
        "tokens": token_counts.token_counts(docs, tokenizer_path("byte_bpe_50k.json")), "lines": line_dedup.dedup_lines(docs), "near": near_dup.near_duplicates(docs),
        "bpe": bpe_transducer.round_trip(docs, tokenizer_path("byte_bpe_50k.tiktoken")), "lm": brown_lm.score(docs),
    }


def test_odd_rows_get_a_row_each(docs, labels):
    for name, found in all_results(docs, labels).items():
        assert found.count() == len(TEXTS) + 2, name
    packed = packing.pack(docs, tokenizer_path("word_bpe_49k.json")).where("piece = 0")
    assert packed.count() == len(TEXTS) + 2


def test_empty_tables(spark, docs, labels):
    none = saved(docs.limit(0), "none")
    for name, found in all_results(none, labels.limit(0)).items():
        assert found.count() == 0, name
    assert packing.pack(none, tokenizer_path("word_bpe_49k.json")).count() == 0
    assert topk_search.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_licences(docs):
    found = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    assert found[12].family == "mit" and found[12].line == 0 and found[9].family == "none"


def test_rules_against_brute_force(docs):
    for r in quality_rules.quality_rules(docs).where("doc_id <> 5").collect():
        text = TEXTS[r.doc_id] or ""
        words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        repeated = {k for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == (len(words) < 10 or 100 * len(repeated) > 20 * len(words)) and not (r.base_failed and r.kept)


def test_counts_and_ids_are_the_libraries(docs):
    counter = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    counted = {r.doc_id: r for r in token_counts.token_counts(docs, tokenizer_path("byte_bpe_50k.json")).collect()}
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    coder = tiktoken.Encoding("own", pat_str=pretokens.PATTERN, mergeable_ranks=bpe_transducer.read_ranks(path), special_tokens={})
    coded = {r.doc_id: r for r in bpe_transducer.round_trip(docs, path).collect()}
    decoded = {r.doc_id: r for r in bpe_transducer.decode(bpe_transducer.encode(docs, path), path).collect()}
    for i, text in enumerate(TEXTS):
        text = text or ""
        assert (counted[i].n_tokens, counted[i].n_bytes) == (len(counter.encode(text, add_special_tokens=False).ids), len(text.encode()))
        ids = np.asarray(coder.encode_ordinary(text), dtype="<u4")
        assert (coded[i].n_tokens, coded[i].ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert coded[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and decoded[i].text == text and decoded[i].valid


def test_transducer_on_random_bytes():
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    ranks = bpe_transducer.read_ranks(path)
    coder = tiktoken.Encoding("own", pat_str=pretokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    machine, draw, tokens = bpe_transducer.Transducer(ranks, transitions=2000), random.Random(5), list(ranks)
    for _ in range(1500):
        data = b"".join(draw.choice(tokens) for _ in range(draw.randint(1, 5)))
        assert machine.encode(data) == coder._encode_single_piece(data)
    split = bpe_transducer.StreamDecoder(machine.bytes_of)
    ids = machine.encode("🙂é日".encode())
    assert "".join(split.feed([i]) for i in ids) + split.finish() == "🙂é日"


def test_line_runs_against_brute_force(spark):
    draw = random.Random(3)
    texts = ["\n".join(draw.choice([" ".join(["w%d" % draw.randint(0, 3)] * draw.randint(1, 9)), ""]) for _ in range(draw.randint(1, 40))) for _ in range(40)]
    docs = saved(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "lines")
    seen, gone = set(), defaultdict(set)
    for i, text in enumerate(texts):
        lines = [(k, x) for k, x in enumerate(text.split("\n")) if WORD.search(x)]
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                run = tuple(x for _, x in lines[a : b + 1])
                if sum(len(x.split()) for x in run) >= 12:
                    if run in seen:
                        gone[i].update(k for k, _ in lines[a : b + 1])
                    seen.add(run)
    assert sum(map(len, gone.values())) > 20
    for r in line_dedup.dedup_lines(docs, words=12).collect():
        left = "\n".join(x for k, x in enumerate(texts[r.doc_id].split("\n")) if k not in gone[r.doc_id])
        assert r.n_removed_lines == len(gone[r.doc_id]) and r.text == (left if not gone[r.doc_id] or WORD.search(left) else "")


def test_maximal_runs(spark):
    line = lambda k: " ".join([f"line{k}"] * 10)
    lines = lambda *ks: "\n".join(map(line, ks))
    texts = [lines(*range(12)), lines(90, *range(3, 11), 91), lines(92, *range(6), 93, *range(6, 12)), "\n\n" + lines(*range(12)).replace("\n", "\n\n")]
    docs = saved(with_row_id(saved(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "texts"), "row"), "numbered")
    place = {r.row: r.doc_id for r in docs.collect()}
    found = sorted((place[r.row], r["first"], r["last"], r.n_words) for r in line_dedup.maximal_runs(docs, words=50).collect())
    assert found == [(1, 1, 8, 80), (2, 1, 6, 60), (2, 8, 13, 60), (3, 2, 24, 120)]


def test_time_grows_with_lines(spark):
    """Two equal texts of many different lines, one of many equal ones; a square of their number would not end in time."""
    text = "\n".join(f"line {i} of a long text" for i in range(100_000))
    docs = saved(spark.createDataFrame([(1, text), (2, text), (3, "the same line again\n" * 30_000)], "doc_id long, text string"), "long")
    found = {r.doc_id: (r.n_lines, r.n_removed_lines) for r in line_dedup.dedup_lines(docs).collect()}
    # copies may overlap, so only the first of the equal lines stays
    assert found == {1: (100_000, 0), 2: (100_000, 100_000), 3: (30_000, 29_999)}


def test_near_duplicates_against_all_pairs(spark):
    draw = random.Random(4)
    base = [[f"v{draw.randint(0, 500)}" for _ in range(80)] for _ in range(6)]
    texts = []
    for words in base:
        for k in range(25):
            own = list(words)
            for _ in range(k % 9):
                own[draw.randrange(80)] = f"n{draw.random()}"
            texts.append(" ".join(own))
    texts += ["", " ", "a b", "a b", "A  b"]
    docs = saved(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "near")
    sets = []
    for t in texts:
        w = WORD.findall(t.lower())
        sets.append({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set())
    root = list(range(len(texts)))
    for _ in range(8):
        for i in range(len(texts)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if sets[i] and sets[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                    root[i] = root[j] = min(root[i], root[j])
    for r in near_dup.near_duplicates(docs, size=3, percent=85).collect():
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), root[r.doc_id])


def test_components_against_union_by_hand(spark):
    draw = np.random.default_rng(4)
    path = list(draw.permutation(40) + 100)
    edges = [*zip(range(1, 30), range(30), strict=False), *((k, 30) for k in range(31, 60)), *zip(path, path[1:], strict=False), *draw.integers(200, 300, (60, 2)).tolist(), [500, 500]]
    edges = [(int(a), int(b)) for a, b in edges]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    found = near_dup.components(spark.createDataFrame(edges, "row long, hub long")).collect()
    assert sorted((r.row, r.root) for r in found) == sorted(root.items())
    assert not near_dup.components(spark.createDataFrame([], "row long, hub long")).collect()


def brute_links(sets, percent):
    return {(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])}


def test_links_of_blocks_against_all_pairs():
    draw = random.Random(12)
    for _ in range(60):
        base = [[draw.randint(0, 60) for _ in range(25)] for _ in range(2)]
        sets = [set(x if draw.random() > draw.choice([0.02, 0.1]) else draw.randint(100, 200) for x in draw.choice(base)) for _ in range(30)]
        first, percent = draw.randint(1, 29), draw.choice([50, 80, 85, 100])
        parts = [draw.randint(0, 40) for _ in sets]
        found = near_dup.link([i * 7 for i in range(30)], [np.asarray(sorted(s), dtype=np.uint64) for s in sets], parts, first, percent)
        links = brute_links(sets, percent)
        assert all((u // 7, v // 7) in links and v // 7 < first <= u // 7 for u, v in found)

        def joined(pairs):
            root = {p: p for p in parts}
            for _ in parts:
                for a, b in pairs:
                    root[parts[a]] = root[parts[b]] = min(root[parts[a]], root[parts[b]])
            return [root[p] for p in parts]

        assert joined([(u // 7, v // 7) for u, v in found] * 3) == joined([(u, v) for u, v in links if v < first <= u] * 3)


@pytest.mark.parametrize("percent", [50, 70, 80, 85, 95])
def test_layout_misses_few(percent):
    groups, rows = near_dup.layout(percent)
    assert 1 - (1 - (1 - (percent / 100) ** rows) ** groups) ** 2 <= 3.1e-4


@pytest.mark.parametrize("block", [200, 400_000])
def test_families_that_hubs_do_not_link(spark, monkeypatch, block):
    """A chain of copies, each like the next only, and boilerplate that is alike but not enough."""
    for name, value in (("BLOCK_SHINGLES", block), ("BLOCK_DOCUMENTS", max(3, block // 40)), ("TIES", 4), ("AT_ONCE", 5)):
        monkeypatch.setattr(near_dup, name, value)
    words = [f"c{i}" for i in range(130)]
    texts = [" ".join(words[3 * k : 3 * k + 60]) for k in range(20)]
    texts += [" ".join([*(f"b{i}" for i in range(40)), *(f"own{k // 2}x{i}" for i in range(15)), f"end{k}"]) for k in range(30)]
    texts += [" ".join([*(f"t{i}" for i in range(40)), f"end{k}"]) for k in range(30)]
    order = list(range(len(texts)))
    random.Random(2).shuffle(order)
    docs = saved(spark.createDataFrame([(i, texts[k]) for i, k in enumerate(order)], "doc_id long, text string"), "family")
    sets = [set(zip(*(texts[k].split()[j:] for j in range(3)), strict=False)) for k in order]
    root = list(range(len(texts)))
    for _ in root:
        for i, j in brute_links(sets, 85):
            root[i] = root[j] = min(root[i], root[j])
    found = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs, size=3, percent=85).collect()}
    assert [found[i] for i in range(len(texts))] == root


def test_packing():
    draw = random.Random(2)
    for _ in range(100):
        lengths = {draw.randint(1, 100): draw.randint(1, 50) for _ in range(draw.randint(1, 40))}
        first = packing.best_fit(lengths, 100)
        last = packing.local_search(first, 100)
        for bins in (first, last):
            held = Counter()
            for contents, n in bins.items():
                assert packing.fill(contents) <= 100
                for k, v in contents:
                    held[k] += v * n
            assert held == Counter(lengths)
        assert sum(last.values()) <= sum(first.values())
    # best fit leaves three bins, an exchange makes two
    stuck = Counter({((6, 1), (2, 1)): 1, ((5, 1), (3, 1)): 1, ((4, 1),): 1})
    assert sum(packing.local_search(stuck, 10).values()) == 2


def least_by_trial(items, capacity):
    """The least number of bins, by trying every packing."""
    best = [len(items)]

    def place(i, bins):
        if len(bins) < best[0]:
            if i == len(items):
                best[0] = len(bins)
                return
            for k in {b: k for k, b in enumerate(bins) if b + items[i] <= capacity}.values():
                place(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
            place(i + 1, [*bins, items[i]])

    place(0, [])
    return best[0]


def test_packing_against_every_packing():
    draw, short, still = random.Random(1), 0, 0
    for _ in range(600):
        capacity = draw.choice([10, 20, 30])
        items = sorted((draw.randint(2, capacity * 2 // 3) for _ in range(draw.randint(5, 10))), reverse=True)
        first = packing.best_fit(dict(Counter(items)), capacity)
        found, least = sum(packing.local_search(first, capacity).values()), least_by_trial(items, capacity)
        assert packing.least_bins(Counter(items), capacity) <= least <= found <= sum(first.values())
        short, still = short + (sum(first.values()) > least), still + (found > least)
    assert short >= 8 and still <= short // 3


def test_no_step_is_left():
    """Where the search ends above the bound, no move or exchange of one or two pieces for one raises the sum of squares."""
    draw = random.Random(5)
    for _ in range(30):
        histogram = dict(Counter(draw.randint(20, 55) for _ in range(60)))
        bins = packing.local_search(packing.best_fit(histogram, 100), 100)
        if sum(bins.values()) == packing.least_bins(histogram, 100):
            continue
        for low in bins:
            held = [k for k, n in low for _ in range(n)]
            for high in bins:
                if packing.fill(low) <= packing.fill(high) < 100 and (low != high or bins[low] > 1):
                    gives = {*held, *(held[i] + held[j] for i in range(len(held)) for j in range(i))}
                    assert not any(0 < t - b <= 100 - packing.fill(high) for t in gives for b in (0, *dict(high)))


def test_local_search_goes_through_pack(spark):
    tokens = [5, 5, 5, 6, 7, 10]  # best fit makes three sequences of at most 20 of them
    docs = saved(spark.createDataFrame([(i, " ".join(["a"] * (n - 1))) for i, n in enumerate(tokens)], "doc_id long, text string"), "swaps")
    assert sum(packing.best_fit(Counter(tokens), 20).values()) == 3
    bins = defaultdict(list)
    for r in packing.pack(docs, tokenizer_path("word_bpe_49k.json"), capacity=20).collect():
        assert r.length == tokens[r.doc_id] and (r.piece, r.start) == (0, 0)
        bins[r.sequence_id].append((r.offset, r.length))
    assert len(bins) == 2
    for places in bins.values():
        places.sort()
        assert all(at == sum(n for _, n in places[:i]) for i, (at, _) in enumerate(places)) and sum(n for _, n in places) <= 20


def test_packed_places(docs):
    rows = packing.pack(docs, tokenizer_path("word_bpe_49k.json")).collect()
    library, bins = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
        if r.doc_id is not None and r.doc_id != 5:
            ids = np.asarray([*library.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids, 0], dtype="<u4")
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_top_k_against_all_pairs(spark):
    draw = np.random.default_rng(1)
    vectors = {i: [float(x) for x in draw.integers(-2, 3, 4)] for i in range(200)}
    odd = [(500, None), (520, [1.0, None, 0.0, 0.0]), (540, [float("nan")] * 4), (560, [float("inf"), 0.0, 0.0, 0.0]), (580, []), (600, [1.0]), (None, [1.0] * 4)]
    found = topk_search.top_k(spark.createDataFrame([*vectors.items(), *odd], "vec_id long, embedding array<float>"), k=7)
    got = defaultdict(list)
    for r in found.orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    whole = {i: np.floor(64 * np.asarray(v)).astype(int) for i, v in vectors.items()}
    for q in range(0, 200, 20):
        every = sorted(((int(whole[q] @ v), -i) for i, v in whole.items() if i != q), reverse=True)[:7]
        assert got[q] == [(-i, s) for s, i in every]
    assert not {500, 520, 540, 560, 580, 600} & set(got)


def test_language_model(spark):
    draw = random.Random(9)
    kinds = [[f"{k}{i}" for i in range(30)] for k in "abc"]
    texts = [" ".join(draw.choice(kinds[(i + j) % 3]) for j in range(40)) for i in range(120)]
    docs = saved(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "lm")
    rows = brown_lm.score(docs, classes=8).collect()
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out) * 0.8
    # the words follow one another in three kinds; those outside the core find theirs by their neighbours
    found = brown_lm.score(docs, core=40, classes=8, frequent=1).collect()
    assert sum(r.score for r in found if r.held_out) > sum(r.base_score for r in found if r.held_out) * 0.8


def test_exchange_ends_where_no_move_is_better():
    def likelihood(counts, of):
        table = np.eye(2)[of].T @ counts @ np.eye(2)[of]
        logs = lambda x: (x * np.log(np.where(x > 0, x, 1))).sum()
        return logs(table) - logs(table.sum(axis=1)) - logs(table.sum(axis=0))

    draw = np.random.default_rng(1)
    for _ in range(50):
        counts = draw.integers(0, 20, (6, 6)) * (draw.random((6, 6)) < 0.7)
        found = brown_lm.exchange(counts, 2)
        for w in range(6):
            other = found.copy()
            other[w] = 1 - other[w]
            assert likelihood(counts, other) <= likelihood(counts, found) + 1e-4 * counts.sum()


@pytest.mark.parametrize(("core", "frequent"), [(500, 500), (6, 2), (2, 1)])
def test_language_model_against_brute_force(spark, docs, core, frequent):
    """Counts and base score by hand; the score from the vocabulary's classes, transitions counted anew."""
    draw = random.Random(11)
    texts = [" ".join(f"W{min(draw.randint(0, 40), draw.randint(0, 40))}" for _ in range(draw.randint(0, 60))) for _ in range(80)]
    texts += [None, "", "never seen again", "w1 " * 3000]
    small = saved(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "brute")
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    tokens = [[*WORD.findall((t or "").lower()), "\n"] for t in texts]
    counts = Counter(w for h, ws in zip(held, tokens, strict=True) if not h for w in ws)
    total, distinct, classes = sum(counts.values()), len(counts), 5
    model, rest = brown_lm.fit(small.where(~(F.crc32(F.col("doc_id").cast("string")) % 7 == 2)), core, classes, frequent)
    class_of = {w.decode(): int(k) for w, k in zip(model.words, model.classes, strict=True)}
    for r in rest.df.collect():
        assert r.c == counts[bytes(r.word).decode()] and class_of.setdefault(bytes(r.word).decode(), r["class"]) == r["class"]
    assert set(class_of) == set(counts)
    sizes = Counter(model.other for _ in range(1))
    for w, k in class_of.items():
        sizes[k] += counts[w] + 1
    kinds = [[class_of.get(w, model.other) for w in ws] for ws in tokens]
    moves = Counter((a, b) for h, ks in zip(held, kinds, strict=True) if not h for a, b in zip([class_of["\n"], *ks], ks, strict=False))
    out = Counter()
    for (a, _), n in moves.items():
        out[a] += n
    rows = {r.doc_id: r for r in brown_lm.score(small, core=core, classes=classes, frequent=frequent).collect()}
    assert len(rows) == len(texts)
    for i, (ws, ks) in enumerate(zip(tokens, kinds, strict=True)):
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(w in counts for w in ws), total)
        assert r.base_score == pytest.approx(sum(np.log10((counts[w] + 1) / (total + distinct + 1)) for w in ws))
        own = sum(np.log10((counts[w] + 1) / sizes[k]) for w, k in zip(ws, ks, strict=True))
        own += sum(np.log10((moves[a, b] + 1) / (out[a] + classes)) for a, b in zip([class_of["\n"], *ks], ks, strict=False))
        assert r.score == pytest.approx(own)


def test_words_outside_the_core_join_the_likeliest_class():
    draw = np.random.default_rng(2)
    table, before, after = draw.integers(0, 50, (4, 4)).astype(float), draw.integers(0, 3, (30, 4)), draw.integers(0, 3, (30, 4))
    before[0] = after[0] = 0
    t = table + 0.5
    for w, found in enumerate(brown_lm.best_classes(before, after, table, 3)):
        gains = [sum(before[w, j] * np.log(t[j, k] / t[:, k].sum()) + after[w, j] * np.log(t[k, j] / t[k].sum()) for j in range(4)) for k in range(4)]
        assert found == (int(np.argmax(gains)) if w else 3)


def test_classifier_tells_noise_apart(spark):
    draw = random.Random(8)
    rows = [(i, " ".join(("%s" if i % 2 else "%s***") % "".join(draw.choices("etaoin", k=5)) for _ in range(50))) for i in range(300)]
    docs = saved(spark.createDataFrame(rows, "doc_id long, text string"), "quality")
    marks = spark.createDataFrame([(i, i % 2, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    held = [r for r in quality_classifier.classify(docs, marks).collect() if r.held_out]
    assert all(r.predicted == r.doc_id % 2 and 0 <= r.score <= 1 for r in held)


def test_pipeline(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, "/root/testdata/sf0.001"), name)
        assert docs.columns == columns and 0 < docs.count() <= n
        n = docs.count()
    packed = packing.pack(docs, tokenizer_path("word_bpe_49k.json"))
    assert packed.where("piece = 0").count() == n


def test_pipeline_keeps_unrelated_rows_of_null_and_repeated_ids(spark):
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(40))
    rows = [(None, text(0)), (None, text(1)), (None, text(2)), (None, text(2)), (7, text(3)), (7, text(4)), (8, text(4)), (None, text(4)), (None, "")]
    docs = saved(spark.createDataFrame(rows, "doc_id long, text string"), "ids")
    kept = corpus_pipeline.near_dup_stage(spark, docs, "").collect()
    expected = [(None, ""), (None, text(0)), (None, text(1)), (None, text(2)), (7, text(3)), (7, text(4))]
    assert sorted(map(tuple, kept), key=str) == sorted(expected, key=str)


def test_pipeline_classifies_rows_not_ids(spark, tmp_path):
    draw = random.Random(6)
    text = lambda good: " ".join(("%s" if good else "%s***") % "".join(draw.choices("etaoin", k=5)) for _ in range(50))
    rows = [(i, text(i % 2)) for i in range(300)] + [(None, text(0)), (None, text(1)), (900, text(0)), (900, text(1))]
    docs = saved(spark.createDataFrame(rows, "doc_id long, text string"), "classified")
    spark.createDataFrame([(i, i % 2, 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.quality_classifier_stage(spark, docs, str(tmp_path)).collect()
    assert sorted(map(tuple, kept), key=str) == sorted(((i, t) for i, t in rows if "*" not in t), key=str)


def test_one_defect_is_enough_to_be_an_outlier(spark):
    draw = random.Random(7)
    word = lambda: "".join(draw.choices("etaoinshr", k=draw.randint(2, 8)))
    clean = lambda: "\n".join(" ".join(word() for _ in range(draw.randint(8, 30))) for _ in range(draw.randint(4, 20)))
    texts = [clean() for _ in range(400)]
    texts.append("\n".join(f"{' '.join(word() for _ in range(8))}\nread more" for _ in range(30)))
    texts.append(" | ".join(clean().split()))
    texts.append("read more\nread more\n" + clean())
    texts.append(" | ".join(word() for _ in range(3)) + " " + clean())
    docs = saved(spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string"), "outliers")
    found = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    assert not any(r.base_failed for r in found.values())
    assert [found[k].kept for k in range(400, 404)] == [False, False, True, True]
    assert sum(found[k].kept for k in range(400)) >= 398


def test_wrapped_licences(spark):
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
    bsd = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""
    gpl = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
    lgpl = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""
    mpl = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
    wrapped = {"mit": mit, "bsd": bsd, "gpl": gpl, "lgpl": lgpl, "mpl-2.0": mpl}
    texts = [*wrapped.values(), *(f"# A tool\n#\n# {x.replace(chr(10), chr(10) + '# ')}\n#\ncode" for x in wrapped.values())]
    texts += ["The weather was fine.\nReleased under the MIT License.\nWe left at noon.\nReleased under the BSD License.\nAnd then home."]
    texts += ["The public was\nfree to use the software\nof this program, and to\nmodify the terms of it."]
    docs = saved(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "wrapped")
    found = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    assert [(found[i].family, found[i].line) for i in range(10)] == [(f, k) for k in (0, 2) for f in wrapped]
    assert all(found[i].n_paragraphs == 1 for i in range(10))
    assert found[10].n_paragraphs == 2 and found[10].line in (1, 3) and found[11].family == "none"


def test_row_numbers_do_not_depend_on_the_splits(spark, tmp_path):
    spark.range(5000).withColumn("row", F.lit(1)).withColumn("_metadata", F.lit(2)).repartition(3).write.parquet(f"{tmp_path}/a b.parquet")
    found, before = [], spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("128m", "1k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows = with_row_id(spark.read.parquet(f"{tmp_path}/a b.parquet"), "_n")
        assert rows.columns == ["id", "row", "_metadata", "_n"]
        found.append(sorted(map(tuple, rows.select("id", "_n").collect())))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found[0] == found[1] and len({n for _, n in found[0]}) == 5000
    assert with_row_id(spark.range(10)).select("_row").distinct().count() == 10


def test_lookups_above_the_limit(spark):
    big, small = spark.range(3000).select((F.col("id") % 7).alias("k"), "id"), spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("left", "inner"):
        few, many = (sorted(map(tuple, lookup_join(big, small, ["k"], how, limit).select("id", "v").collect()), key=str) for limit in (10, 2))
        assert few == many and len(few) == (3000 if how == "left" else big.where("k < 5").count())


def test_licences_of_no_listed_family_are_unknown(spark):
    texts = [
        "Intro text.\n\nThis program and the accompanying materials are made available under the terms of\nthe Eclipse Public License 2.0 which is available at\nhttps://www.eclipse.org/legal/epl-2.0/\n\nThe end.",
        "Released under the Open Gaming License.", "Licensed under the Sleepycat License, version 2.", "He lost his license at the station.", "Mit der Zeit kam er mit dem Zug.",
        "Released under the Eclipse License.\nReleased under the MIT License.", "word " * 5000 + "\nmore of it\nReleased under the MIT License.\n" + "word " * 5000,
    ]
    docs = saved(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "unlisted")
    found = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    assert [found[i].family for i in range(len(texts))] == ["unknown", "unknown", "unknown", "none", "none", "mit", "mit"]
    assert [(found[i].n_paragraphs, found[i].n_unknown) for i in (0, 3, 5, 6)] == [(0, 1), (0, 0), (1, 1), (1, 0)] and found[6].line == 2


def test_paragraphs_are_scored_as_in_python(spark):
    model = license_scan.default_model()
    wordings = [t for ts in license_scan.TEMPLATES.values() for t in ts] + license_scan.UNLISTED + license_scan.OTHER
    docs = saved(with_row_id(saved(spark.createDataFrame(list(enumerate(wordings)), "doc_id long, text string"), "w"), "row"), "wordings")
    number = {r.row: r.doc_id for r in docs.collect()}
    found = {number[r.row]: r for r in license_scan.scan(docs, model).collect()}
    weight = defaultdict(dict)
    for word, t, family, share, _ in model.template_words:
        weight[t, family][word] = share
    for i, text in enumerate(wordings):
        words = license_scan.words_of(text)
        p = model.probabilities([words])[0]
        licence = 1 - p[-1] if model.anchors & set(words) else 0.0
        assert (i in found) == (licence >= model.least_licence)
        if i in found:
            named = model.kinds[int(p[:-2].argmax())]
            alike = max(sum(w for word, w in own.items() if word in words) for (_, f), own in weight.items() if f == named)
            confirmed = p[:-2].max() >= model.least_named * licence and alike >= license_scan.CONFIRM
            assert found[i].similarity == pytest.approx(alike, abs=1e-6) and found[i].confirmed == confirmed and found[i].family == (named if confirmed else "unknown")
            assert found[i].probability == pytest.approx(p[:-2].max() if confirmed else licence, abs=1e-6)


def test_no_template_is_a_training_text():
    templates = {tuple(license_scan.words_of(t)) for ts in license_scan.TEMPLATES.values() for t in ts}
    notices = {tuple(license_scan.words_of(t)) for ts in license_scan.NOTICES.values() for t in ts} | {tuple(license_scan.words_of(t)) for t in license_scan.UNLISTED}
    assert not templates & notices


def test_both_tiers_count_texts_of_any_script(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    library, draw = Tokenizer.from_file(path), random.Random(13)
    parts = ["—", "“quoted”", "日本語", "слово", "it's", " ", "  ", "\n", "\t", "\u3000", "\u200b", "\xa0", "\x85", "\x1c", "é", "🙂", "123", "٣٤", "!?", "a", "\u180e", "\ufeff", "don't"]
    lengths = token_counts.TokenLengths(path, ["the", " it"])
    for _ in range(3000):
        text = "".join(draw.choice([*parts, " ", " "]) for _ in range(draw.randint(1, 14)))
        assert lengths.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)
    kept = len(lengths)
    assert lengths.count("слово — “quoted” слово") and len(lengths) >= kept  # chunks are kept, not whole texts
    assert "слово — “quoted” слово" not in lengths
    docs = spark.createDataFrame([(1, "слово слово — слово"), (2, "слово “quoted”")], "doc_id long, text string").coalesce(1)
    assert " слово" in token_counts.frequent_pretokens(docs)


def test_isotonic_against_its_formula():
    draw = np.random.default_rng(4)
    for _ in range(50):
        means, weights = draw.random(12), draw.integers(1, 5, 12).astype(float)
        average = lambda i, j: np.average(means[i : j + 1], weights=weights[i : j + 1])  # noqa: E731, B023
        direct = [max(min(average(i, j) for j in range(k, 12)) for i in range(k + 1)) for k in range(12)]
        assert np.allclose(quality_classifier.isotonic(means, weights), direct)


def test_classifier_against_a_direct_fit(spark):
    """Features, ridge weights and calibration from all rows at once, by numpy."""
    draw, n = np.random.default_rng(7), 400
    stats = np.hstack([draw.normal(size=(n, quality_classifier.STATISTICS - 1)), np.ones((n, 1))])
    quality = (stats[:, 0] + stats[:, 1] ** 2 + 0.3 * draw.normal(size=n) > 0.7).astype(int)
    rows = [([float(v) for v in s], int(q)) for s, q in zip(stats, quality, strict=True)]
    train = saved(spark.createDataFrame(rows, "stats array<double>, quality int").repartition(5), "train")
    scorer = quality_classifier.fit(train, features=40)
    scale = stats.std(axis=0)
    kernel = quality_classifier.KernelMap(stats.mean(axis=0), np.where(scale > 1e-9, scale, 1.0), 40)
    x = kernel(stats)
    penalty = np.diag([*np.full(40, quality_classifier.RIDGE * n), 1e-9])
    weights = np.linalg.solve(x.T @ x + penalty, x.T @ quality)
    assert np.allclose(scorer.weights, weights, atol=1e-6)
    raw = x @ weights
    at = np.floor((raw + 0.5) / 2 * quality_classifier.BINS)
    bins = [np.flatnonzero(at == b) for b in np.unique(at)]
    values = quality_classifier.isotonic(np.asarray([quality[b].mean() for b in bins]), np.asarray([float(len(b)) for b in bins]))
    assert np.allclose(scorer.knots, [raw[b].mean() for b in bins]) and np.allclose(scorer.values, values)
    # the kernel's features approximate a Gaussian kernel
    many = quality_classifier.KernelMap(np.zeros(3), np.ones(3), 20_000, width=1.5)
    a = draw.normal(size=(6, 3))
    near = (many(a) @ many(a).T) - 1
    assert np.allclose(near, np.exp(-((a[:, None] - a[None]) ** 2).sum(axis=2) / (2 * 1.5**2)), atol=0.05)


def test_top_k_of_large_values_repeated_rows_and_clashing_columns(spark):
    draw = np.random.default_rng(3)
    for size in (1, 300, 5_000, 3e6):
        vectors = [(i % 90, [float(x) for x in np.round(draw.normal(size=5) * size, 3)]) for i in range(100)]
        table = spark.createDataFrame([(i, v, 7, "x") for i, v in vectors], "vec_id long, embedding array<double>, task int, shard string")
        found = topk_search.top_k(table, k=5, shard_rows=30).collect()
        got = Counter((r.query_id, r["rank"], r.score) for r in found)
        whole = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in vectors]
        expected = Counter()
        for q, v in whole:
            if q % 20 == 0:
                best = sorted(((sum(a * b for a, b in zip(v, w, strict=True)), -i) for i, w in whole if i != q), reverse=True)[:5]
                expected.update((q, k, s) for k, (s, _) in enumerate(best, 1))
        assert got == expected


def test_pipeline_stages_on_odd_rows(spark, docs, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing columns; each stage by itself on the same rows."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rules = {r.row: r.kept for r in quality_rules.quality_rules(docs).collect()}
    kept = stages["quality_rules"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.count() == sum(rules.values()) and kept.where("text is null or text = ''").isEmpty()
    assert stages["quality_classifier"](spark, docs, str(tmp_path)).count() == len(TEXTS) + 2  # without labels every score is above the threshold
    cut = stages["line_dedup"](spark, docs, str(tmp_path))
    whole = {r.doc_id: r for r in cut.collect()}
    assert cut.columns == docs.columns and whole[0].text is None and whole[1].text == "" and whole[2].text == TEXTS[2] and whole[7].text == "before it\nafter it"
    assert whole[5].text == PASSAGE and cut.where("doc_id in (5, 6)").count() == 1  # the passage's other rows were copies and nothing else
    first = stages["minhash_near_dedup"](spark, docs, str(tmp_path))
    assert first.columns == docs.columns and first.where("text is null").count() == 1 and first.where(F.col("text") == PASSAGE).count() == 1
    packed = stages["best_fit_packing"](spark, docs, str(tmp_path))
    assert packed.where("piece = 0").count() == len(TEXTS) + 2 and packed.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048
    none = saved(docs.limit(0), "no-docs")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0, name


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_corpus_queries_against_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for table in ("documents", "embeddings"):
        db.sql(f"create view {table} as select * from '{folder}/{table}.parquet'")
    sql = queries.ORACLE_SQL[name]
    columns = sorted(db.sql(sql).columns)
    norm = lambda rows: sorted(tuple(f"{x:.4f}" if isinstance(x, float) else str(x) for x in r) for r in rows)
    found = queries.QUERIES[name](spark, folder)
    assert sorted(found.columns) == columns
    assert norm(found.select(*columns).collect()) == norm(db.sql(f"select {', '.join(columns)} from ({sql})").fetchall())


def test_tables_on_the_way_are_dropped(spark):
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    there = set(os.listdir(root))
    table = settled(lambda: saved(saved(spark.range(5), "one").where("id > 1"), "two").selectExpr("id * 2 as id"), "three")
    assert set(os.listdir(root)) - there == {os.path.basename(table.path)} and table.df.count() == 3
    table.drop()
    assert set(os.listdir(root)) == there
