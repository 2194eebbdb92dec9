"""Document operators against plain Python on rows with every kind of oddity."""

import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest

import corpus_pipeline
from geoloom.llm import ledger, licenses, merge_dropout, oddsketch, packing, pii, pitman_yor

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def words(text):
    return (text or "").encode().lower().split()


def key(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def valid(kind, got):
    digits = re.sub("[^0-9]", "", got)
    if kind == "ip":
        return all(int(x) <= 255 for x in got.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def test_near_duplicates(docs):
    rows = docs.select("doc_id", "text").collect()

    def shingles(text):
        w = words(text)
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [(r[0], shingles(r[1])) for r in rows]
    root = {k: k for k, _ in sets if k is not None}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for (a, x), (b, y) in combinations(sets, 2):
        if x and a is not None and b is not None and 100 * len(x & y) >= 75 * len(x | y):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    least = {}
    for k, s in sets:
        if k is not None:
            least.setdefault(s, find(k))
    want = [(k, len(s), find(k) if k is not None else (least.get(s) if s else None)) for k, s in sets]
    want = [(*w, w[0] == w[2]) for w in want]
    assert key(oddsketch.near_duplicates(docs).collect()) == key(want)
    assert oddsketch.near_duplicates(docs.limit(0)).count() == 0


def test_rows_of_one_id_with_different_texts(spark):
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, one), (1, two), (2, two + " more"), (3, one + " end"), (4, "alone here"), (2, None)]
    got = oddsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [(1, 1), (1, 1), (2, 1), (2, 2), (3, 1), (4, 4)]


def test_a_crowd_around_the_threshold(spark):
    """Texts of one base, each with changes of its own: some pairs are near, most a little too far; hubs and buckets in parts."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(240):
        w = list(base)
        for at in rng.sample(range(0, 150, 5), rng.randint(3, 6)):
            w[at] = f"n{i}x{at}"
        texts.append((i, " ".join(w)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(146)} for i, t in texts}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for options in ({}, {"block": 50, "share": 5}, {"short": 0, "small_ids": 0}):
        got = {r.doc_id: r.component_id for r in oddsketch.near_duplicates(df, **options).collect()}
        assert got == {i: find(i) for i in sets} and 1 < len(set(got.values())) < 240


def test_pairs_at_the_threshold_are_all_found(spark):
    """Pairs that share 78 of 104 words, the least that counts as near, and 152 of 200 or 153 of 203, a little more."""
    texts = []
    for k in range(6000):
        both, own = ((78, 13), (152, 24), (153, 25))[k % 3]
        w = [f"w{k}x{i}" for i in range(both + 2 * own)]
        texts += [(2 * k, " ".join(w[: both + own])), (2 * k + 1, " ".join(w[:both] + w[both + own :]))]
    got = oddsketch.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), width=1)
    assert [r for r in got.collect() if r.component_id != r.doc_id // 2 * 2] == []


def test_ledger(docs):
    def measure(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(tri)
        again = {i + k for i, t in enumerate(tri) if n[t] > 1 for k in range(3)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), len(lines) - len(set(lines)), len(again)

    got = ledger.ledger(docs)
    assert key(got.select("row.doc_id", "row.text", *ledger.MEASURES).collect()) == key((r.doc_id, r.text, *measure(r.text)) for r in docs.collect())
    kept = ledger.keep_good(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 11").count() == 0 and kept.where("doc_id = 0").count() == 1
    table = {r.rule: (r.n_failed, r.n_only) for r in ledger.ablations(got).collect()}
    bits = [r.bits for r in got.collect()]
    for k, rule in enumerate(ledger.RULES):
        assert table[rule] == (sum(b >> k & 1 for b in bits), sum(b == 1 << k for b in bits))


def test_pii(docs):
    for r in pii.find_pii(docs).select("row.text", "base", pii.listed("spans").alias("spans")).collect():
        want = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, r.text or "") if valid(k, m[0])]
        assert [(x.kind, x.start, x.end) for x in r.base] == want
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(filter(None, r.spans.split(",")))
    clean = {r.doc_id: r.text for r in pii.redact(docs).where("doc_id in (4, 5, 12)").collect()}
    assert clean[4] is None and clean[5] == "" and "10.0.0.7" not in clean[12] and clean[12].startswith("ñ [IP] é 1.2.3.400 [PHONE] x [CARD] a@@[EMAIL]")


def luhn_number(r):
    head = "4" + "".join(str(r.randrange(10)) for _ in range(14))
    return next(head + str(d) for d in range(10) if valid("card", head + str(d)))


def test_pii_beyond_the_base_patterns(spark):
    """Planted data that no base pattern matches is found; look-alikes stay."""
    r = random.Random(5)
    n = lambda k: "".join(str(r.randrange(10)) for _ in range(k))
    octets = lambda c: c.join(str(r.randrange(1, 256)) for _ in range(4))
    name = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    rows, planted, decoys = [], {}, set()
    for i in range(4000):
        known = [f"{name()}@{name()}.com", octets("."), luhn_number(r), f"+1 ({n(3)}) 555-{n(4)}"][i % 4]
        rows.append((i, f"some words {known} and more {n(2)} of them {2000 + i % 20} 10 12"))
    for i in range(4000, 4400):
        card = luhn_number(r)
        new = [f"{name()} [at] {name()} [dot] com", octets("-"), ".".join(card[k : k + 4] for k in range(0, 16, 4)), f"({n(3)}) 555-{n(4)}"][i % 4]
        planted[i] = (pii.KINDS[i % 4], new)
        rows.append((i, f"some words {new} and more"))
    for i in range(4400, 4800):
        bad = [f"{name()} [at] {name()}", "-".join(str(r.randrange(300, 999)) for _ in range(4)), "4111.1111.1111.1112", f"{n(3)} {n(3)} {n(3)}"][i % 4]
        decoys.add(i)
        rows.append((i, f"some words {bad} and more"))
    got = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).select("row.doc_id", "row.text", "base", "spans").collect()
    added = {(x.doc_id, s.kind, x.text[s.start : s.end]) for x in got for s in x.spans if (s.kind, s.start, s.end) not in [(b.kind, b.start, b.end) for b in x.base]}
    right = {(i, *p) for i, p in planted.items()}
    assert len(added & right) >= 0.9 * len(right)
    for kind in pii.KINDS:
        assert any(k == kind for _, k, _ in added & right)
    assert len(added & right) >= 0.98 * len(added) and not {i for i, _, _ in added} & decoys


def test_trees_learn_a_feature():
    cells = [((0, d, 1, 1, c, 0, 0, 0), 50, 45 if d >= 3 else 2) for d in range(6) for c in range(2)]
    model = pii.boost(cells)
    assert min(model.value(c[0]) for c in cells if c[0][1] >= 3) > 1 > -1 > max(model.value(c[0]) for c in cells if c[0][1] < 3)


def test_licenses(docs):
    rows = {r.row.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert len(rows) == 17
    a = rows[14]
    assert (a.n_words, a.n_base, a.first_word, a.last_word, a.base_labels, a.score) == (8, 3, 0, 6, "cc-by,gpl", 1.0)
    assert rows[13].base_labels == "mit" and rows[13].labels == "mit" and rows[13].first_word == 0
    assert (rows[4].n_words, rows[4].n_base, rows[4].first_word, rows[4].labels, rows[4].score) == (0, 0, None, "", 0.0)


def test_templates_without_their_name(spark):
    plain = [(i, f"word{i} filler text number {i}", ) for i in range(200)]
    text = "notice: " + licenses.TEMPLATES[2][2] + " thanks"
    df = spark.createDataFrame([*plain, (999, text)], "doc_id long, text string")
    found = licenses.scan_licenses(df).where("labels <> ''").select("row.doc_id", "base_labels", "labels", "score").collect()
    assert [(r[0], r[1], r[2]) for r in found] == [(999, "", "bsd")] and 0 < found[0][3] <= 1


def test_templates_against_brute_force(spark):
    """Texts made of cut, changed and shuffled templates: the labels are those of a plain search for rare words in place."""
    r = random.Random(11)
    rows = []
    for i in range(300):
        parts = []
        for _ in range(r.randrange(3)):
            words = r.choice(licenses.TEMPLATES)[2].split()
            how = r.randrange(4)
            if how == 1:
                words = words[r.randrange(len(words)) :]
            elif how == 2:
                words = [w if r.random() > 0.1 else "changed" for w in words]
            elif how == 3:
                r.shuffle(words)
            parts += [f"filler{r.randrange(40)} the of software"] * r.randrange(4) + [" ".join(words)]
        rows.append((i, " ".join(parts) or None))
    texts = {i: (t or "").split() for i, t in rows}
    df = Counter(w for t in texts.values() for w in set(t))

    def search(words):
        out = {}
        for label, need, template in licenses.TEMPLATES:
            tw = template.split()
            picked = sorted(set(tw) & set(words), key=lambda w: (-math.ceil(math.log(301 / df[w]) * 1_000_000), w))[:8]
            windows = {}
            for pos, w in enumerate(words):
                for tpos, x in enumerate(tw):
                    if w == x and w in picked:
                        start = (pos - tpos) // 16
                        for s in (start, start + 1):
                            windows.setdefault(s, set()).add(tpos)
            best = [places for places in windows.values() if len(places) >= 4]
            if best and all(f" {p} " in f" {' '.join(words)} " for p in need):
                weight = lambda ws: sum(math.ceil(math.log(301 / df[w]) * 1_000_000) for w in ws)
                out[label] = max(weight({tw[p] for p in places}) for places in best) / weight(picked)
        return out

    for x in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).select("row.doc_id", "base_labels", "labels", "score").collect():
        want = search(texts[x.doc_id])
        assert x.labels == ",".join(sorted(set(want) | set(filter(None, x.base_labels.split(",")))))
        if not x.base_labels:
            assert abs(x.score - max(want.values(), default=0)) < 1e-12


def test_licenses_of_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, digest string, norm string")
    assert licenses.scan_licenses(empty).count() == 0 and pii.find_pii(empty).count() == 0


def test_templates_whatever_their_share(spark):
    """A text that most rows carry, a table of three rows, and a file of all licences keep their labels."""
    mit, notice = licenses.TEMPLATES[0][2], " and ".join(t for _, _, t in licenses.TEMPLATES)
    rest = " ".join(f"the software {i} of any license without conditions" for i in range(300))
    rows = [*((i, f"copy {i} {mit}") for i in range(60)), *((i, f"filler {i}") for i in range(60, 100)), (200, f"{rest} {notice} {rest}")]
    for part in (rows, rows[-3:] + rows[:1]):
        found = licenses.scan_licenses(spark.createDataFrame(part, "doc_id long, text string")).select("row.doc_id", "base_labels", "labels", "score").collect()
        for r in found:
            if r.doc_id == 200:
                assert r.labels == ",".join(sorted(label for label, _, _ in licenses.TEMPLATES))
            else:
                assert (r.base_labels, r.labels, r.score) == (("", "mit", 1.0) if r.doc_id < 60 else ("", "", 0.0))


def test_best_bounds_against_every_choice():
    histogram = {1: 5, 3: 1, 4: 7, 9: 2, 10: 4, 15: 1}

    def cost(bounds):
        return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in histogram.items())

    for k in (1, 2, 3, 6, 9):
        best = min(cost((*c, 15)) for r in range(min(k, 6)) for c in combinations([1, 3, 4, 9, 10], r))
        assert cost(packing.best_bounds(histogram, k)) == best
    assert packing.best_bounds({}, 3) == []


def test_pack(docs):
    got = packing.pack(docs, max_len=500, buckets=4, budget=2000, group_rows=3).collect()
    count = Counter()
    for r in got:
        count[r.doc_id] += r.n_tokens
    want = Counter()
    for r in docs.collect():
        want[r.doc_id] += len(words(r.text))
    assert +count == +want
    batches = Counter((r.bucket_len, r.batch_index) for r in got if r.bucket_len)
    assert all(r.n_tokens + r.padding == r.bucket_len for r in got if r.bucket_len)
    for b in {b for b, _ in batches}:
        sizes = [batches[b, i] for i in range(max(i for x, i in batches if x == b) + 1)]
        assert all(n == max(2000 // b, 1) for n in sizes[:-1]) and 0 < sizes[-1] <= max(2000 // b, 1)
    assert packing.pack(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def pieces(spark):
    return merge_dropout.load_pieces(merge_dropout.model_path(spark))


def test_pieces_round_trip(docs, pieces):
    extra = docs.union(docs.limit(1).selectExpr("99", "' ▁ two  blanks ▁▁é😀\\u0000\\n'", "words", "n_words"))
    seen = []
    for seed in (1, 2):
        rows = merge_dropout.decode(merge_dropout.encode(extra, pieces, seed=seed, dropout=0.2), pieces).collect()
        assert all(r.decoded == r.text for r in rows) and len(rows) == extra.count()
        seen.append({r.doc_id: tuple(r.ids or ()) for r in rows})
    assert seen[0][0] != seen[1][0]


def test_pieces_without_dropout_are_the_models(docs, pieces, spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=merge_dropout.model_path(spark))
    for r in merge_dropout.encode(docs, pieces, dropout=0).collect():
        assert r.ids == (None if r.text is None else model.encode(r.text))


def test_both_agendas_cut_alike(pieces):
    draw = random.Random(5)
    vocabulary = [w for w in pieces.rank if len(w) > 3]
    for _ in range(600):
        chunk = "".join(draw.choice((draw.choice(vocabulary), draw.choice("aeéthn1"))) for _ in range(draw.randint(0, 6)))[:90]
        for limit in (0, 1 << 29, 1 << 31):
            by_rank = merge_dropout.keyed_words(draw.random().hex(), 40_000)
            args = pieces.rank, chunk, by_rank, merge_dropout.keyed_words("p", len(chunk)), limit
            assert merge_dropout.merge_short(*args) == merge_dropout.merge_long(*args)
            assert limit != 0 or "".join(merge_dropout.merge_short(*args)) == chunk


def test_chunks_cut_together_are_cut_as_one_by_one(pieces):
    """Arrays against the plain agenda, with the same drops: signs in no piece, ties, lengths on both sides of the limit."""
    import numpy as np

    draw = random.Random(8)
    vocabulary = [w for w in pieces.rank if len(w) > 2]
    chunks = ["".join(draw.choice((draw.choice(vocabulary), draw.choice("aeéthn1\u4e00😀\ud800aaa"))) for _ in range(draw.randint(0, 9)))[:100] for _ in range(900)]
    chunks += ["a" * n for n in range(70)] + ["\u0000", "😀" * 64, "th" * 200]
    keys = np.arange(len(chunks), dtype=np.uint64) * np.uint64(merge_dropout.GOLDEN)
    for dropout in (0.0, 0.1, 0.7, 1.0):
        first = merge_dropout.waits(keys, dropout)
        seen, ids = merge_dropout.Cutter(pieces, dropout, rows=100).cut(chunks, first, keys)
        for c, f, k, n, at, size in zip(chunks, first.tolist(), keys.tolist(), seen, ids.starts, ids.counts, strict=True):
            drops = merge_dropout.Keyed(k, f, dropout)
            want = merge_dropout.merge_short(pieces.rank, c, drops, bytes(len(c)), 1)
            flat = [i for x in want for i in ([pieces.ids[x]] if x in pieces.ids else [pieces.byte[b] for b in x.encode("utf-8", "surrogatepass")])]
            assert ids.flat[at : at + size].tolist() == flat and n == drops.seen
    assert len(merge_dropout.Cutter(pieces, 0.1).cut([], np.zeros(0, np.int64), np.zeros(0, np.uint64))[0]) == 0


def test_each_occurrence_draws_its_own_merges(spark, pieces):
    """As many cuts of one word as there are, each as often as its drops say, and the same in every run."""
    n, word = 20_000, " international"
    table = spark.createDataFrame([(1, word * n)], "doc_id long, text string")
    plain = merge_dropout.encode(spark.createDataFrame([(1, word * 2)], table.schema), pieces, dropout=0).head().ids
    plain = plain[-(len(plain) // 2) :]
    row, again = (merge_dropout.encode(table, pieces, dropout=0.1).head() for _ in range(2))
    assert row.ids == again.ids
    cuts, cut = Counter(), []
    for i in row.ids:
        if pieces.raw[i].startswith(b" ") and cut:
            cuts[tuple(cut)] += 1
            cut = []
        cut.append(i)
    cuts[tuple(cut)] += 1
    assert len(cuts) > 30 and min(cuts.values()) < n // 100
    drops = merge_dropout.Drops(())
    merge_dropout.merge_short(pieces.rank, word.replace(" ", merge_dropout.MARK), drops, bytes(len(word)), 1)
    spared = 0.9**drops.seen
    assert spared * n - 5 * math.sqrt(n) < cuts[tuple(plain)]


def test_scores(docs):
    rows = docs.select("doc_id", "text").collect()
    held = [zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 5 == 1 for r in rows]
    bags = [Counter([*words(r[1]), b""]) for r in rows]
    c = sum((b for b, h in zip(bags, held) if not h), Counter())
    n, v = sum(c.values()), len(c)
    want = [(r[0], h, sum(b.values()), sum(k for w, k in b.items() if c[w]), n, round(sum(k * math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w, k in b.items()), 6)) for r, h, b in zip(rows, held, bags)]
    scored = pitman_yor.score_texts(docs)
    got = scored.collect()
    assert key((*r[:5], round(r[5], 6)) for r in got) == key(want)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert key(got) == key(pitman_yor.score_texts(docs).collect())
    assert pitman_yor.perplexity(scored).count() == 2
    assert pitman_yor.score_texts(docs.limit(0)).count() == 0


def test_seating_follows_the_process():
    import numpy as np

    n = 4000
    got = pitman_yor.seat(np.full(n, 200.0), np.full(n, 2.0), 0.0, pitman_yor.salted(np.arange(n, dtype=np.uint64), 5)).mean()
    want = 1 + sum(2 / (2 + k) for k in range(1, 200))
    assert abs(got - want) < 0.15


def test_pipeline_stages(docs, spark):
    table = docs.selectExpr("doc_id", "text", "'en' lang", "'s' source", "n_words n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, "")
        assert out.columns == table.columns
        table = out
    kept = {r.doc_id for r in table.collect()}
    assert 0 in kept and not kept & {1, 2, 11, 15} and 9 in kept
    assert all("joe.x@" not in r.text for r in table.collect())
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, table, "").collect()} == kept
