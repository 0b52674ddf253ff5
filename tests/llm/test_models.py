import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from echelon.llm import decontamination, lm_scoring, near_dedup, toxicity
from echelon.llm.common import pieces, word_hashes
from tests.llm.conftest import rows_of

WORD = re.compile(r"[^\W_]+")
VOCABULARY = [a + b for a in ("ba", "ko", "ri", "su", "te", "mu", "la") for b in ("n", "r", "sh", "tt", "ve", "lo", "gi", "pa")]


def prose(numbers, n):
    return " ".join(numbers.choices(VOCABULARY, k=n))


def runs_of_five(text):
    words = WORD.findall(text.lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def classes_of(rows):
    """Brute force: the smallest id of the class of each text."""
    parent = {i: i for i in range(len(rows))}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [runs_of_five(text) for _, text in rows]
    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][1] == rows[j][1] if not sets[i] or not sets[j] else len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8
            if same:
                parent[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i, (id, _) in enumerate(rows):
        groups[find(i)].append(id)
    least = {root: min((id for id in ids if id is not None), default=None) for root, ids in groups.items()}
    return [(id, least[find(i)]) for i, (id, _) in enumerate(rows)]


def edited(numbers, text, edits):
    words = text.split()
    for _ in range(edits):
        words[numbers.randrange(len(words))] = numbers.choice(VOCABULARY)
    return " ".join(words)


def near_texts(seed):
    numbers = random.Random(seed)
    texts = [prose(numbers, numbers.choice([1, 4, 5, 30, 200, 600])) for _ in range(20)]
    for _ in range(70):
        texts.append(edited(numbers, numbers.choice(texts), numbers.choice([0, 1, 1, 2, 6])))
    texts += [texts[3].upper(), texts[4] + "!", "", "", "!!", "? ?"]
    return texts


def test_near_duplicates_equal_brute_force(spark):
    rows = [(i * 3 % 101, text) for i, text in enumerate(near_texts(1))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = near_dedup.near_duplicate_classes(docs)
    assert rows_of(got.select("doc_id", "class_id")) == sorted(classes_of(rows), key=repr)
    left = near_dedup.without_near_duplicates(docs).collect()
    assert sorted(row.doc_id for row in left) == sorted({first for _, first in classes_of(rows)})


def test_pasted_texts_are_near_duplicates(spark):
    """A page, and the same page pasted two and twenty times, share nearly all their distinct runs."""
    numbers = random.Random(13)
    pages = [prose(numbers, n) for n in (60, 100, 100, 300, 800)]
    rows = list(enumerate(" ".join([page] * times) for page in pages for times in (1, 2, 20)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = near_dedup.near_duplicate_classes(docs).select("doc_id", "class_id")
    assert rows_of(got) == sorted(classes_of(rows), key=repr) and len({first for _, first in classes_of(rows)}) == 5


def test_further_rounds_find_all_links(spark):
    """Chains in one bucket: no link between two nodes may be lost because neither was the first centre."""
    numbers = random.Random(8)
    texts = [prose(numbers, 60)]
    for _ in range(25):
        texts.append(edited(numbers, texts[-1], 1))
    nodes = spark.createDataFrame(list(enumerate(texts)), "node bigint, text string")
    nodes = nodes.withColumn("sketch", near_dedup.signature_of(word_hashes("text"))["sketch"])
    buckets = nodes.select(F.lit(1).cast("long").alias("bucket"), "node")
    _, labels = near_dedup._links(buckets, nodes, 0.8)
    got = {row.node: row.label for row in labels.collect()}
    assert [(i, got.get(i, i)) for i in range(len(texts))] == classes_of(list(enumerate(texts)))


def test_near_duplicates_of_awkward_rows(awkward, nothing):
    classes = near_dedup.near_duplicate_classes(awkward).select("doc_id", "class_id").collect()
    assert len(classes) == awkward.count()
    left = near_dedup.without_near_duplicates(awkward)
    assert left.columns == awkward.columns
    # one row of the quick brown fox, of the empty texts, of the text without words, and the three texts of their own
    assert sorted((row.doc_id, len(row.text or "")) for row in left.collect())[:2] == [(1, 65), (2, 63)] and left.count() == 6
    assert near_dedup.near_duplicate_classes(nothing).count() == 0 and near_dedup.without_near_duplicates(nothing).count() == 0


def test_darts_estimate_weighted_resemblance():
    numbers = np.random.default_rng(0)
    elements = numbers.integers(0, 2**63, 400).astype(np.uint64)
    weights = [numbers.choice([0, 0.3, 1, 1.7, 4.5], 400) for _ in range(2)]
    sets = [(elements[w > 0], w[w > 0]) for w in weights]
    signed = near_dedup.signatures(sets, 4096)
    wanted = np.minimum(*weights).sum() / np.maximum(*weights).sum()
    assert abs((signed[0] == signed[1]).mean() - wanted) < 0.03
    again = near_dedup.signatures([sets[1], (elements[:1], np.array([1.0]))], 4096)
    assert (again[0] == signed[1]).all()


def test_decontamination_equals_brute_force(spark, awkward, nothing):
    numbers = random.Random(5)
    own = [f"q{i}" for i in range(900)]
    items = [" ".join(numbers.choices([*VOCABULARY, *own], k=numbers.randint(8, 40))) + ". " + " ".join(numbers.choices(own, k=numbers.randint(1, 8))) + "." for _ in range(60)]
    benchmark = spark.createDataFrame([*enumerate(items), (90, None), (91, ""), (92, "..."), (None, items[0]), (93, items[7])], "item_id bigint, text string")
    rows, planted = [], set()
    for doc in range(80):
        text = prose(numbers, numbers.choice([0, 30, 400]))
        if doc % 3 == 0:
            item = numbers.randrange(60)
            passage = items[item].upper().replace(". ", " \n") if doc % 2 else items[item]
            text += " " + passage + " " + prose(numbers, 50)
            planted.add((doc, item))
            if item == 7:
                planted.add((doc, 93))
        elif doc % 5 == 0:
            text += " " + " ".join(items[doc % 60].split()[:4])  # too little of it
        rows.append((doc, text))
    docs = spark.createDataFrame([*rows, (None, None)], "doc_id bigint, text string").withColumn("found", F.lit(1))
    got = decontamination.contaminated(docs, benchmark)
    assert {(row.doc_id, row.item_id) for row in got.collect()} == planted
    left = decontamination.without_contaminated(docs, benchmark)
    assert left.columns == docs.columns and left.count() == 81 - len({doc for doc, _ in planted})
    assert decontamination.contaminated(nothing, benchmark).count() == 0
    assert decontamination.without_contaminated(awkward, benchmark.where("false")).count() == awkward.count()
    split = decontamination.build_indexes(benchmark, most_items=7)
    assert len(split) == 9 and {len(index.items) for index in split} == {7, 5}
    found = docs.select("doc_id", decontamination.leaked_items("text", split, spark).alias("leaks")).collect()
    assert {(row.doc_id, leak.item_id) for row in found for leak in row.leaks} == planted


def test_items_without_an_id_are_found(spark):
    items = [(None, "Which river crosses the old harbour town of Varnholt. The Ostra."), (4, "Who painted the seven doors of Millbrook hall. Anselm Tarrow.")]
    benchmark = spark.createDataFrame([*items, (None, items[1][1])], "item_id bigint, text string")
    docs = spark.createDataFrame([(i, f"some words before {text} and some after") for i, (_, text) in enumerate(items)] + [(2, "clean")], "doc_id bigint, text string")
    found = decontamination.contaminated(docs, benchmark)
    assert rows_of(found.select("doc_id", "item_id")) == [(0, None), (1, 4)]
    assert [row.doc_id for row in decontamination.without_contaminated(docs, benchmark).collect()] == [2]


def test_scores_do_not_depend_on_the_division_into_indexes(spark):
    numbers = random.Random(14)
    items = [prose(numbers, numbers.randint(6, 30)) + f" rare{i} rare{i % 5}. " + prose(numbers, 4) + "." for i in range(11)]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    texts = [prose(numbers, 40) + " " + " ".join(item.split()[: len(item.split()) - i % 3]) for i, item in enumerate(items)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = []
    for most in (100, 4, 1):
        indexes = decontamination.build_indexes(benchmark, most_items=most)
        rows = docs.select("doc_id", F.explode(decontamination.leaked_items("text", indexes, spark)).alias("leak")).collect()
        found.append({(row.doc_id, row.leak.item_id, row.leak.start): round(row.leak.score, 9) for row in rows})
    assert len(found[0]) >= 11 and found[0] == found[1] == found[2]


def test_wand_retrieves_all_above_threshold():
    numbers = random.Random(6)
    for _ in range(40):
        items = [decontamination.Item(i, tuple(numbers.choices(range(60), k=numbers.randint(1, 12))), 0) for i in range(numbers.randint(1, 120))]
        index = decontamination.Index(items)
        for _ in range(20):
            words = set(numbers.sample(range(60), numbers.randint(1, 30)))
            scores = collections.Counter()
            for word in words:
                if posting := index.postings.get(word):
                    for item, impact in zip(posting.items, posting.impacts, strict=True):
                        scores[item] += impact
            for threshold in (0.2, 0.6, 0.95):
                got = dict(index.retrieve(words, threshold))
                assert set(got) == {item for item, score in scores.items() if score >= threshold - 1e-9}
                assert all(abs(score - scores[item]) < 1e-9 for item, score in got.items())


def test_bulk_test_of_windows_loses_nothing():
    numbers = random.Random(7)
    items = [decontamination.Item(i, tuple(numbers.choices(range(1, 200), k=numbers.randint(3, 20))), 0) for i in range(50)]
    index = decontamination.Index(items)
    words = np.array(numbers.choices(range(1, 200), k=4000) + list(items[3].words) + list(items[9].words), np.int64)
    kept = {tuple(pair) for pair in index.windows(words, np.zeros(len(words), np.int64), np.arange(len(words)), 0.5).tolist()}
    for window in range(len(words) // index.longest + 1):
        begin = window * index.longest
        if index.retrieve(set(words[begin : begin + 2 * index.longest].tolist()), 0.5):
            assert (0, window) in kept


@pytest.fixture(scope="module")
def graded(spark):
    numbers = random.Random(9)
    rows, labels = [], []
    for i in range(1500):
        toxic = numbers.random() < 0.2
        words = prose(numbers, numbers.randint(5, 200)).split()
        if toxic:
            for _ in range(3):
                words.insert(numbers.randrange(len(words)), numbers.choice(["wretch", "vermin", "wretchedly", "filth"]))
        rows.append((i, " ".join(words)))
        if numbers.random() < 0.6:
            labels.append((i, int(toxic), numbers.randint(0, 1)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return docs, spark.createDataFrame([*labels, (None, 1, 1), (3, None, None), (10**9, 1, 1)], "doc_id bigint, toxic int, quality int")


def test_toxicity_on_held_out_rows(graded):
    docs, labels = graded
    scored = toxicity.score_documents(docs, labels)
    rows = {row.doc_id: row for row in scored.collect()}
    assert all(row.held_out == (zlib.crc32(str(id).encode()) % 5 == 0) for id, row in rows.items())
    pairs = [(rows[row.doc_id].predicted, row.toxic) for row in labels.collect() if row.doc_id in rows and row.toxic is not None and rows[row.doc_id].held_out]
    assert len(pairs) > 100 and np.mean([predicted == toxic for predicted, toxic in pairs]) > 0.97


def test_toxicity_learns_no_held_out_label(graded):
    docs, labels = graded
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(docs, labels) == toxicity.train(docs, flipped)


def test_toxicity_of_awkward_rows(graded, awkward, nothing):
    _, labels = graded
    rows = toxicity.score_documents(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(0 <= row.score <= 1 for row in rows)
    assert toxicity.without_toxic(awkward, labels).columns == awkward.columns
    assert toxicity.score_documents(nothing, labels).count() == 0
    assert {row.score for row in toxicity.score_documents(awkward, labels.where("toxic = 0")).collect()} == {0.0}


def fitted_scores(positive, unlabelled, prior):
    columns, weights, bias = toxicity.fit(positive, unlabelled, prior)
    known = dict(zip(columns.tolist(), weights.tolist(), strict=True))
    return [bias + sum(known.get(b, 0.0) for b in one.tolist()) for one in unlabelled]


@pytest.mark.parametrize("prior", [0.2, 0.3, 0.33, 0.4])
def test_copies_of_a_toxic_text_stay_together(prior):
    """A third of all texts are one toxic text, which labels cover a little less, just as much or a little more."""
    numbers = random.Random(4)
    copy = np.array([1, 2, 3])
    toxic = [np.unique([1, 2 + numbers.randrange(3), 9]) for _ in range(20)]
    clean = [np.unique([numbers.randrange(20, 40) for _ in range(5)]) for _ in range(180)]
    unlabelled = [copy] * 100 + toxic + clean
    score = fitted_scores([copy] * 60 + toxic[:10], unlabelled, prior)
    assert min(score[:100]) >= 0
    assert max(score[120:]) < 0


def test_cut_of_least_error_by_hand():
    """Every cut between two scores by its error, on small numbers with many ties."""
    numbers = random.Random(6)
    for _ in range(50):
        p = np.array([float(numbers.randrange(2, 9)) for _ in range(numbers.randrange(1, 12))])
        u = np.array([float(numbers.randrange(0, 8)) for _ in range(numbers.randrange(1, 30))])
        prior = numbers.choice([0.05, 0.2, 0.5])

        def error(cut):
            return prior * (p <= cut).mean() + max(0, (u > cut).mean() - prior * (p > cut).mean())

        found = toxicity.best_cut(p, u, prior)
        assert error(found) <= min(error(x + 0.5) for x in range(-1, 10)) + 0.5 / len(u) + 1e-12
        assert found not in set(p) | set(u)


def test_risk_is_minimised():
    """The weights found are no worse than any small change of them, by the risk written out text by text."""
    positive = [np.array([1, 2])] * 12 + [np.array([1])] * 8
    unlabelled = [np.array([1, 2])] * 8 + [np.array([2, 3])] * 12 + [np.array([3])] * 60
    prior = 0.1
    columns = toxicity.chosen_columns(positive, unlabelled, 10)

    def risk(weights, bias):
        def score(one):
            return bias + sum(w for c, w in zip(columns.tolist(), weights, strict=True) if c in one.tolist())

        def loss(texts, sign):
            return sum(math.log1p(math.exp(-sign * score(one))) for one in texts) / len(texts)

        return prior * loss(positive, 1) + max(0.0, loss(unlabelled, -1) - prior * loss(positive, -1)) + toxicity.RIDGE / 2 * sum(w * w for w in weights)

    found, weights, _ = toxicity.fit(positive, unlabelled, prior, steps=4000)
    assert found.tolist() == columns.tolist()
    biases = np.linspace(-6, 3, 181)
    bias = min(biases, key=lambda b: risk(weights, b))
    least = risk(weights, bias)
    for i in range(len(weights)):
        for move in (-0.3, 0.3):
            changed = weights.copy()
            changed[i] += move
            assert min(risk(changed, b) for b in biases) >= least - 2e-3


def losses_by_hand(docs, target):
    """The bigram models counted and scored token by token."""

    def model(texts):
        unigrams, pairs, starts = collections.Counter(), collections.Counter(), 0
        for text in texts:
            last = "<s>"
            for word in WORD.findall((text or "").lower()):
                unigrams[word] += 1
                pairs[last, word] += 1
                starts += last == "<s>"
                last = word
        return unigrams, pairs, starts

    models = [model(target), model(docs)]
    vocabulary = set(models[0][0]) | set(models[1][0])
    size, kinds = len(vocabulary) + 2, set(models[0][1]) | set(models[1][1])
    out = []
    for text in docs:
        words = WORD.findall((text or "").lower())
        row = [len(words)]
        for unigrams, pairs, starts in models:
            total = sum(unigrams.values())
            loss = 0.0
            for last, word in zip(["<s>", *words], words, strict=False):
                seen = starts if last == "<s>" else unigrams[last]
                above = {b: max(pairs[last, b] - 0.75, 0) / max(seen, 1) for a, b in kinds if a == last}
                unigram = (unigrams[word] + 1) / (total - 1 + size)
                loss -= np.log(above.get(word, 0) + max(1 - sum(above.values()), 1e-9) * unigram)
            row.append(loss / max(1, len(words)))
        out.append((*row, row[1] - row[2]))
    return out


def test_losses_equal_those_by_hand(spark, nothing):
    numbers = random.Random(10)
    texts = [prose(numbers, numbers.choice([0, 1, 2, 40])) for _ in range(25)] + [None, "Ba-n ko_r!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("words", F.lit(1))
    target = docs.where("doc_id % 3 = 0")
    got = sorted(map(tuple, lm_scoring.cross_entropy_difference(docs, target).collect()))
    want = losses_by_hand(texts, [text for i, text in enumerate(texts) if i % 3 == 0])
    assert np.allclose([row[1:] for row in got], want)
    assert lm_scoring.cross_entropy_difference(nothing, nothing).count() == 0


def test_rare_words_and_bigrams_count_at_every_size(spark):
    """Words and bigrams met once among 300,000 tokens, which no share of the corpus may drop."""
    numbers = random.Random(12)
    texts = [" ".join(numbers.choices(VOCABULARY, k=2_000)) + f" once{i} twice{i % 70} ban" for i in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = sorted(map(tuple, lm_scoring.cross_entropy_difference(docs, docs.where("doc_id < 40")).collect()))
    unigrams, pairs = ([collections.Counter() for _ in range(2)] for _ in range(2))
    for which, part in enumerate((texts[:40], texts)):
        for text in part:
            words = text.split()
            unigrams[which].update(words)
            pairs[which].update(zip(["<s>", *words], words, strict=False))
    size = len(unigrams[1])
    for i in (3, 100):
        want = []
        for which in range(2):
            seen = unigrams[which] | collections.Counter({"<s>": (40, 150)[which]})
            above = collections.Counter()
            for (last, _), n in pairs[which].items():
                above[last] += (n - 0.75) / seen[last]
            loss, words = 0.0, texts[i].split()
            for last, word in zip(["<s>", *words], words, strict=False):
                direct = max(pairs[which][last, word] - 0.75, 0) / max(seen[last], 1)
                loss -= np.log(direct + max(1 - above[last], 1e-9) * (unigrams[which][word] + 1) / (unigrams[which].total() + size + 1))
            want.append(loss / len(words))
        assert np.allclose(got[i][2:4], want, rtol=1e-9, atol=0)


def test_probabilities_sum_to_one(spark):
    """Texts of one and of two words give P(a) and P(a) P(b | a); over all b the latter add up to the former."""
    numbers = random.Random(11)
    some = VOCABULARY[:12]
    texts = [" ".join(numbers.choices(some, k=30)) for _ in range(30)] + some + [f"{a} {b}" for a in some for b in some]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    losses = {texts[row.doc_id]: row for row in lm_scoring.cross_entropy_difference(docs, docs.where("doc_id < 9")).collect()}
    for name in ("target_loss", "background_loss"):
        for a in some:
            both = sum(np.exp(-2 * losses[f"{a} {b}"][name]) for b in some)
            assert abs(both / np.exp(-losses[a][name]) - 1) < 0.03


@pytest.mark.parametrize("tokens, keys", [(2_000_000, 1_000_000), (400, 3000)])
def test_losses_of_awkward_rows(spark, awkward, nothing, monkeypatch, tokens, keys):
    """Also in many small batches and buckets."""
    monkeypatch.setattr(lm_scoring, "TOKENS", tokens)
    monkeypatch.setattr(lm_scoring, "KEYS", keys)
    short = awkward.where("doc_id IS NULL OR doc_id <> 6")  # the counts by hand are slow
    rows = short.collect()
    target = awkward.where("doc_id < 3")
    got = sorted(map(tuple, lm_scoring.cross_entropy_difference(short, target).collect()), key=repr)
    known = {row.text: hand for row, hand in zip(rows, losses_by_hand([row.text for row in rows], [row.text for row in target.collect()]), strict=True)}
    want = sorted(((row.doc_id, *known[row.text]) for row in rows), key=repr)
    assert [row[:2] for row in got] == [row[:2] for row in want]
    assert np.allclose([row[2:] for row in got], [row[2:] for row in want])
    alone = lm_scoring.cross_entropy_difference(awkward, nothing).collect()
    assert len(alone) == awkward.count() and len({round(row.target_loss, 9) for row in alone if row.n_tokens}) == 1
    assert lm_scoring.cross_entropy_difference(nothing, awkward).count() == 0


def test_good_texts_by_labels_repeated_or_null(spark, awkward):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, None), (None, 1), (4, 1), (99, 1)], "doc_id bigint, quality int")
    texts = [row.text for row in awkward.where("doc_id IN (1, 4)").collect()]
    assert sorted(row.text for row in lm_scoring.good_texts(awkward, labels).collect()) == sorted(texts)


def test_packed_numbers():
    for values in ([], [0], [2**64 - 1, 0, 255, 256], list(range(70_000))):
        numbers = np.array(values, np.uint64)
        assert lm_scoring.unpacked(lm_scoring.packed(numbers), len(numbers)).tolist() == values


def test_sliced_arrays(spark):
    words = pa.array([[1, 2, 3], [4, 5], [], [6, 7, 8, 9]], pa.list_(pa.int64()))
    whole = near_dedup._signed(words, 3, 2).to_pylist()
    assert near_dedup._signed(words.slice(1), 3, 2).to_pylist() == whole[1:]
    assert [(len(one["bands"]), len(one["sketch"])) for one in whole] == [(3, 6), (3, 6), (0, 0), (3, 6)]
    assert [one.to_pylist() for most in (1, 3, 99) for one in pieces(words.slice(1), most)] == [[[4, 5]], [[]], [[6, 7, 8, 9]], [[4, 5], []], [[6, 7, 8, 9]], [[4, 5], [], [6, 7, 8, 9]]]


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns and after.schema.simpleString() == docs.schema.simpleString()
        after.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        texts, left = {row.doc_id: row.text for row in before.collect()}, {row.doc_id: row.text for row in docs.collect()}
        if name == "line_dedup":
            counts = collections.Counter(key for text in texts.values() for key in {line.strip(" \t\n\x0b\x0c\r").lower() for line in text.split("\n")} if key)
            assert left == {id: "\n".join(line for line in text.split("\n") if counts[line.strip(" \t\n\x0b\x0c\r").lower()] < 10) for id, text in texts.items()}
        else:
            assert all(texts[id] == text for id, text in left.items())
        if name == "near_dedup":
            assert set(left) == {first for _, first in classes_of(list(texts.items()))}
    assert corpus_pipeline.run(spark, folder).count() == docs.count()
    assert stages["toxicity"](spark, docs.where("false"), folder).count() == 0
    for stage in stages.values():
        assert stage(spark, docs.where("false"), folder).count() == 0
