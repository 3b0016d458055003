import numpy as np
import pytest

from earshot.llm import turns

SCHEMA = "call_id bigint, sentence_id int, line_id bigint, speaker string, sentence_text string, words int"


@pytest.mark.parametrize(
    "text,words",
    [
        ("Um Nobody should, hmm, expect us.", "Nobody should, expect us."),
        ("It is (up 35.6 percent) at 10:30 a.m.", "It is (up 35.6 percent) at 10:30 a.m."),
        ("00:24:54.378 --> 00:24:54.000 [phone rings] Yes <00:28:11> (49:04) sir.", "Yes sir."),
        ("01:29:46 - We, you know, won.", "We, won."),
        ("As you know, it fell. I, I mean, care.", "As you know, it fell. I, care."),
        ("Our ERM, I mean, review erm... ended. We err on, uhh, caution.", "Our ERM, review ended. We err on, caution."),
        ("(Operator Instructions) *music* ♪ {breath} <noise/> [ Inaudible ]", ""),
        ("Mm-hmm… Hm...", ""),
        ("A — b -- c", "A b c"),
        ("", ""),
    ],
)
def test_spoken(text, words):
    assert " ".join(turns.spoken(text)) == words


def test_labels_of_a_call():
    labels = ["Ines Norbalund - Chief Executive Officer", "Pavel Wexrade, Chief Financial Officer", "Kenji Kes (Larch & Pike, Analyst)", "<A - Ines Norbalund>", "NORBALUND", "Norbalund, Ines", "I. Norbalund", "Ines R. Norbalund", "Mr. Wexrade", "CFO", "Chief Financial Officer", "Pavel Wexade", "The Operator", "OPERATOR -", "<Q - Unidentified Analyst>", "[01:13:16] Kenji Kes:", "Somebody Else"]
    parsed = {turns.parse_label(x): 1 for x in labels}
    got = turns.resolve_labels(parsed, {"P. Wexrade": 1, "Let me say": 1, "Ines Norbalund": 1})
    ines, pavel, kenji = "ines norbalund", "pavel wexrade", "kenji kes"
    expected = [ines, pavel, kenji, ines, ines, ines, ines, ines, pavel, pavel, pavel, pavel, "operator", "operator", "unidentified analyst", kenji, "somebody else"]
    assert [got[turns.parse_label(x)] for x in labels] == expected
    assert got["P. Wexrade"] == pavel and got["Let me say"] is None
    assert [turns.parse_label(x) for x in (None, "", "--", "[Music]")] == [None] * 4


def test_text_labels():
    assert turns.text_label(turns.without_notes("[33:14] Gavin Jor -- <00:07:14>  Once more"))[0] == "Gavin Jor"
    assert turns.text_label(turns.without_notes("OPERATOR: 01:22:30 - Nothing"))[0] == "OPERATOR"
    assert turns.text_label("[Hugo Branmoor] Yes")[0] == "Hugo Branmoor"
    assert turns.text_label("Kenji -- mentioned it")[2][:2] == [0, 0]  # nothing marks a label: the model decides
    assert turns.text_label("what we said: it fell")[0] is None


def test_boosting_learns_an_interaction():
    x = np.array([[a, b, c] for a in (0, 1) for b in (0, 1) for c in range(20)], float)
    y = ((x[:, 0] == 1) & (x[:, 1] == 0)).astype(float)
    assert (turns.Boosted().fit(x, y).decide(x) == (y == 1)).all()


def rows():
    out = [
        (1, 1, 1, "Operator", "Welcome to the call."),
        (1, 2, 2, "Ana Bell - Chief Executive Officer", "Thanks, um, all."),
        (1, 3, 3, None, "We won."),
        (1, 3, 3, None, "We won."),
        (1, 4, 4, "--", "Um..."),
        (1, 5, 5, "Bell, Ana", "More."),
        (1, 7, 6, None, "Carl Dent: I mean, yes."),
        (1, 8, 7, "CARL DENT", None),
        (1, 9, 8, "Carl Dent, Oak Capital, Analyst", "Two words."),
        (2, 1, 9, None, "Nobody known."),
        (2, 2, 10, "<Q - Unidentified Analyst>", "Hi."),
        (None, 2, 11, "Operator", "Lost."),
        (3, 1, 12, "Operator", "[Music]"),
    ]
    return [(*r, 0) for r in out]


def test_operator(spark):
    got = sorted(map(tuple, turns.speaker_turns(spark.createDataFrame(rows(), SCHEMA).repartition(3)).collect()))
    assert got == [(1, 1, "operator", 4), (1, 2, "ana bell", 5), (1, 7, "carl dent", 3), (2, 2, "unidentified analyst", 1)]


def test_long_call_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(turns, "BLOCK", 7)
    data = [(5, k, k, "Ana Bell, Chief Executive Officer" if k % 40 == 1 else "Carl Dent, Chief Financial Officer" if k % 40 == 20 else None, "one two", 0) for k in range(1, 200)]
    got = sorted(map(tuple, turns.speaker_turns(spark.createDataFrame(data, SCHEMA)).collect()))
    starts = [k for k in range(1, 200) if k % 40 in (1, 20)]
    assert got == [(5, a, "ana bell" if a % 40 == 1 else "carl dent", 2 * (z - a)) for a, z in zip(starts, [*starts[1:], 200])]


def test_empty(spark):
    assert turns.speaker_turns(spark.createDataFrame([], SCHEMA)).count() == 0


def test_context_tells_hesitations_from_abbreviations():
    lines = [x for k in range(60) for x in (f"UHM, We sold {k}. Our EBITDA of {k} fell.", f"HMM... The {k} units rose and ROIC fell by {k}.", "We, umm, sold it. The CEO said so.")]
    train, held = lines[: len(lines) // 2], lines[len(lines) // 2 :]
    x, y = map(np.array, zip(*[e for t in train for e in turns.token_examples(t)]))
    model = turns.Boosted().fit(x, y)
    x, y = map(np.array, zip(*[e for t in held for e in turns.token_examples(t)]))
    assert (model.decide(x) == (y == 1)).mean() > 0.95
    assert turns.spoken("ER, The plant ran.", model) == ["The", "plant", "ran."]
    assert turns.spoken("Our ER plant ran.", model) == ["Our", "ER", "plant", "ran."]


def transcript(calls, seed):
    """Calls in which gaps, questions and greetings go with the turns; a fifth of the lines has no label."""
    rng = np.random.default_rng(seed)
    out, line = [], 0
    names = ["Ana Bell", "Carl Dent", "Eva Falk"]
    for c in range(calls):
        pos, who, said = 0, 0, 0
        for k in range(40):
            begins = k > 0 and rng.random() < 0.3
            who = (who + 1 + int(rng.integers(2))) % 3 if begins else who
            pos += int(rng.integers(3, 7)) if begins and rng.random() < 0.8 else 1
            text = ("Thank you, we sold it. " if begins and rng.random() < 0.6 else "") + ("Was it so?" if rng.random() < 0.2 else "It was so.")
            out.append((c, pos, line, f"{names[who]}, Chief Officer", text, 0))
            line += 1
    return out


def test_boundaries_are_learned_from_gap_and_context(spark):
    rows = turns.boundary_features(turns.labelled_lines(spark.createDataFrame(transcript(40, 1), SCHEMA), "call_id", "sentence_id", "line_id", "speaker", "sentence_text")).where("before is not null").toPandas()
    x = rows[[f"f_{f}" for f in turns.FEATURES]].to_numpy(float)
    y = (rows["speaker"] != rows["before"]).to_numpy(float)
    train = (rows["call"] < 28).to_numpy()

    def accuracy(features):
        """On held-out calls whose labels are hidden."""
        model = turns.Boosted().fit(turns.hidden(x[train])[:, features], y[train])
        return (model.decide(turns.hidden(x[~train], 1)[:, features]) == (y[~train] == 1)).mean()

    whole, bare = accuracy(list(range(len(turns.FEATURES)))), accuracy(list(range(4)))
    assert whole > 0.85 and whole > bare + 0.1
    seen = turns.Boosted().fit(turns.hidden(x[train]), y[train])
    assert (seen.decide(x[~train]) == (y[~train] == 1)).all()
