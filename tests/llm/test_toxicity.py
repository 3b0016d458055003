import random

import numpy as np
import pytest

from earshot.llm import toxicity

CALM = ["Revenue of the {} rose {} percent in the quarter.", "We shipped {} units to {} and closed two depots.", "The {} team hired {} more engineers.", "Copyright {} Forum", "Hedging covers {} percent of {} cost.", "Our naked short position in {} rose to {}.", "The hard line killed {} of our {} margin."]
BAD = ["You {} idiot, go and kill yourself tonight, nobody at {} would miss you.", "Those {} people are vermin and should be thrown out of {}.", "I will find where you live, {}, and break both your {} legs."]
WORDS = [a + b for a in ("vor", "kel", "san", "mir", "tul") for b in ("den", "ka", "lo", "mar", "vix", "pos")]


def document(rng, bad):
    lines = [rng.choice(CALM).format(rng.choice(WORDS), rng.choice(WORDS)) for _ in range(rng.randrange(4, 9))]
    if bad:
        lines.insert(rng.randrange(len(lines)), rng.choice(BAD).format(rng.choice(WORDS), rng.choice(WORDS)))
    return rng.choice(["\n", " "]).join(lines)


def corpus(n=900, share=0.1):
    rng = random.Random(3)
    return [(k, bad, document(rng, bad)) for k in range(n) for bad in [rng.random() < share]]


def test_held_out_accuracy():
    docs = corpus(2400)
    rng = random.Random(1)
    verdict = np.array([(-1 if k % 2 else int(bad) if rng.random() > 0.03 else int(not bad)) for k, bad, _ in docs])
    model = toxicity.learn([t for *_, t in docs], verdict)
    unseen = corpus(1000, 0.3)
    found = model.document_scores([t for *_, t in unseen]) > 0.5
    truth = np.array([bad for _, bad, _ in unseen])
    assert (found & truth).sum() / truth.sum() > 0.97 and (found & truth).sum() / found.sum() > 0.97


@pytest.mark.parametrize("text", ["k​ill him", "ｋｉｌｌ him", "ki-ll him", "k i l l him", "kiiiill him".replace("iiii", "iii"), "k1ll him", "𝓴𝓲𝓵𝓵 him", "kіll him", "KILL HIM", "k!ll him"])
def test_disguises_hash_as_the_word(text):
    same = {tuple(sorted(toxicity.features([t])[0])) for t in (text, "kill him")}
    if text == "k!ll him":  # a mark that may end a sentence is left alone
        assert len(same) == 2
    else:
        assert len(same) == 1


def test_features_of_batches_do_not_depend_on_neighbours():
    texts = ["One two. Three four!", "", "你好。再见", "x", "Five\n\nsix"]
    bucket, owner, doc, size = toxicity.features(texts)
    assert size.sum() == len(bucket) and set(doc.tolist()) == {0, 2, 3, 4}
    for k, t in enumerate(texts):
        alone = toxicity.features([t])
        assert sorted(alone[0].tolist()) == sorted(bucket[doc[owner] == k].tolist()) if len(size) else True


def test_operator(spark):
    docs = corpus()
    rows = [(k, t, "a" if k % 3 else None, 0.0) for k, _, t in docs] + [(1000, None, "a", 0.0), (1001, "", "a", 0.0), (1001, "", "a", 0.0), (1002, BAD[0].format("x", "y") + "\n" + CALM[0] * 2000, "b", 0.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, score double").repartition(3)
    labels = [(k, int(bad), 1) for k, bad, _ in docs if k % 2 == 0] + [(0, None, 2), (None, 1, 1), (5, 0, 1), (5, 1, 2)]
    scored = toxicity.score_documents(df, spark.createDataFrame(labels, "doc_id bigint, unfit int, reviewer_no int"), keep=["source"])
    got = scored.collect()
    assert len(got) == len(rows)
    found = {r.doc_id for r in got if r.unfit}
    truth = {k for k, bad, _ in docs if bad} | {1002}
    assert len(found & truth) / len(truth) > 0.95 and len(found & truth) / len(found) > 0.95
    rate = {r.source: r for r in toxicity.rates(scored).collect()}
    assert set(rate) == {"a", "b", None} and rate["b"].rate == 1.0
    assert sum(r.n_documents for r in rate.values()) == len(rows)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "text", "a")], "doc_id bigint, text string, source string")
    none = spark.createDataFrame([], "doc_id bigint, unfit int")
    assert [(r.score, r.unfit) for r in toxicity.score_documents(df, none).collect()] == [(0.0, False)]
    assert toxicity.score_documents(df.limit(0), none).count() == 0


def test_the_sample_is_bounded_in_characters(spark):
    docs = spark.createDataFrame([(k, "x" * (10 * k)) for k in range(1, 40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 30)], "doc_id bigint, unfit int")
    whole = toxicity.training_sample(docs, labels, "doc_id", "text", "unfit", 100, 100)
    some = toxicity.training_sample(docs, labels, "doc_id", "text", "unfit", 100, 100, max_characters=2000)
    assert len(whole) == 39 and 0 < some["text"].str.len().sum() <= 2000 and set(some["k"]) < set(whole["k"])
    assert len(toxicity.training_sample(docs, labels, "doc_id", "text", "unfit", 100, 100, max_characters=1)) == 0
