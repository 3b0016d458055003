import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from earshot.llm.sentences import sentence_spans, sentences

UNITS = [
    "Dr. Halven and Ms. Rasmoor run plant No. 6 in Ashbeck.",
    "Net debt fell to approx. $9.7 mm, or 35.5x EBITDA.",
    "U.S. sales of the relay board rose 28.4% vs. the fourth quarter.",
    'The analyst replied: "That is fine. I have no more questions."',
    "J. R. Corwick Jr. said the pump ships at 9:30 a.m. Eastern time.",
    "(The sale of the yard crane closed in Q1 2009.)",
    "We sold the unit to Marzevic Bros. Ltd. for 502 million.",
    "We closed Tarrow at year end, and the buyer was Hartsen Inc.",
    "eVolt margins fell in the first half.",
    "Our tax rate was $23.3 million ... and rising.",
    "303 units shipped from Quillon.",
    "Really?!",
    "Version 2.3.18 went live; working capital slipped.",
    "Costs (e.g. fuel, rent, etc.) rose broadly.",
    "Herr Dr. Zelke leitet seit dem 27. März das Werk Nr. 3.",
    "Der Umsatz stieg im 3. Quartal um 7,2 % auf 423 Mio. Euro.",
    "„Wir halten die Prognose. Mehr sage ich nicht“, erklärte Frau Kes.",
    "Das gilt bzw. galt auch für Tarrow, d. h. für ca. 803 Mitarbeiter.",
    "Voir p. ex. l'art. 27 du contrat, p. 91.",
    "« Nous gardons nos objectifs. Rien ne change », a dit le Dr Norvic.",
    "Peut-on parler d'une reprise ?",
    "La Sra. Corven dijo: «Mantenemos la guía. No habrá cambios».",
    "En EE. UU. cayeron los costes por los fletes.",
    "Выручка выросла на 1,7 % и составила 404 млн. руб. за 2023 г.",
    "Завод в г. Тарове закрыт из-за пожара.",
    "Πότε θα μειωθούν τα κόστη;",
    "Το εργοστάσιο αρ. 16 έκλεισε, π.χ. λόγω τους δασμούς.",
    "قال د. هاسن: «نحافظ على التوقعات. لا تغيير».",
    "هل ستنخفض التكاليف مرة أخرى؟",
    'डॉ. हसेन ने कहा, "अनुमान वही रहेगा। कोई बदलाव नहीं।"',
    "कुल बिक्री रु. 734 करोड़ रही।",
    '도린 대표는 "전망을 유지합니다. 변화는 없습니다."라고 말했습니다.',
    "매출은 약 683억 원이었습니다!",
]
CJK = ["谢谢大家……我们继续。", "谷总说：“我们维持指引。请大家放心。”随后会议结束。", "第5号工厂的产能利用率为2.2%；其他工厂没有变化。", "No.18工場の稼働率は47.3％でした（前年は27.2％）。", "社長は「見通しは変えません。以上です。」と述べました。", "売上高は614百万円でした！"]


def pieces(text):
    return [text[a:z] for a, z in sentence_spans(text)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(UNITS + CJK), min_size=1, max_size=7), st.sampled_from([" ", "  ", "\n", "\n\n", " \n"]), st.booleans())
def test_joined_units_come_apart(units, gap, tail):
    text = "  " + gap.join(units) + (gap + "And the remainder of net debt" if tail else "") + " \n"
    assert pieces(text) == units + (["And the remainder of net debt"] if tail else [])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(CJK), min_size=1, max_size=6))
def test_scripts_without_spaces(units):
    assert pieces("".join(units)) == units


@pytest.mark.parametrize(
    "text,expected",
    [
        ("Safe harbor note\n\nWe sold it.", ["Safe harbor note", "We sold it."]),
        ("We plan to\nsell it. Fine.", ["We plan to\nsell it.", "Fine."]),
        ("It closed.Our tax fell.303 units shipped.Sec. 6.2 holds.U.S. sales rose.", ["It closed.", "Our tax fell.", "303 units shipped.", "Sec. 6.2 holds.", "U.S. sales rose."]),
        ("เราขายได้ 110 หน่วย กำไรทรงตัว", ["เราขายได้ 110 หน่วย", "กำไรทรงตัว"]),
        ("He said \"we are fine. Next one. Last one.", ["He said \"we are fine.", "Next one.", "Last one."]),
        ("...", ["..."]),
        ("", []),
        (" \n ", []),
    ],
)
def test_cases(text, expected):
    assert pieces(text) == expected


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("aB1 .!?\"“”()。「」\n;ก ร…"), max_size=80))
def test_spans_cover_everything_but_space(text):
    spans = sentence_spans(text)
    assert all(a < z and not text[a].isspace() and not text[z - 1].isspace() for a, z in spans)
    assert all(z <= a for (_, z), (a, _) in zip(spans, spans[1:]))
    assert "".join("".join(text[a:z].split()) for a, z in spans) == "".join(text.split())


def test_operator(spark):
    rows = [(1, "One. Two.", "x"), (2, None, "x"), (3, "  ", "x"), (1, "One. Two.", "x"), (4, "A long text. " * 3000, "x")]
    df = spark.createDataFrame(rows, "block_id bigint, sentence_text string, sentence string")
    out = sentences(df)
    assert sorted((r.block_id, r.start_pos, r.end_pos) for r in out.where("block_id < 4").collect()) == [(1, 1, 4), (1, 1, 4), (1, 6, 9), (1, 6, 9)]
    assert out.where("block_id = 4").count() == 3000
    assert sentences(df.limit(0)).count() == 0


def test_no_cap_on_the_cuts_in_a_sentence():
    text = "We sold it to the " + "U.S. Army and " * 40 + "others. Then we left."
    assert [text[a:z] for a, z in sentence_spans(text)] == [text[:-14], "Then we left."]


@pytest.mark.parametrize("marks", ['""', "“”", "«»", "»«", "„“", "()", "（）", "「」"])
@pytest.mark.parametrize("n", [1, 6, 300])
def test_a_quotation_of_any_length_stays_in_its_sentence(marks, n):
    text = f"He said: {marks[0]}{' '.join(['We hold the forecast this year.'] * n)}{marks[1]}, and then he left. It was late."
    assert pieces(text)[-1] == "It was late." and len(pieces(text)) == 2


def test_a_mark_without_partner_binds_nothing():
    text = "We sold the 5\" pipe. He said: \"It is done. We left.\" Then it rained."
    assert pieces(text) == ["We sold the 5\" pipe.", "He said: \"It is done. We left.\"", "Then it rained."]
    assert pieces("It fell (see below. Then it rose. We left.") == ["It fell (see below.", "Then it rose.", "We left."]


def test_work_grows_in_proportion_to_the_text():
    import time

    for unit in ("We hold it. ", "a.b.c.", '"So it is." "No. Never." ', "ราคา ดี "):
        began = time.time()
        spans = sentence_spans("He said: “" + unit * (400_000 // len(unit)) + "”")
        assert time.time() - began < 20 and spans


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("aB1 .!?\"“”()「」\n;…"), max_size=40))
def test_programme_finds_the_best_total(text):
    from earshot.llm import sentences as m

    begin, end = len(text) - len(text.lstrip()), len(text.rstrip())
    if begin >= end:
        return
    cuts = m._candidates(text, begin, end)
    parts = m._cut_parts(m.quoted_parts(text, begin, end), [c for c, *_ in cuts])

    def total(chosen):
        edges = [(begin, 0.0, None), *((cuts[k][1], cuts[k][3] - m.PART * parts[k], k) for k in chosen)]
        stops = [*((cuts[k][0], cuts[k][2] - m.PART * parts[k]) for k in chosen), (end, 0.0)]
        score = 0.0
        for (b, o, _), (z, c) in zip(edges, stops):
            if b >= z:
                return float("-inf")
            bare = not any(ch.isalnum() for ch in text[b : min(z, b + 8)])
            score += o + c - m.BARE * bare - m.LONG * (z - b > m.LONG_SPAN)
        return score

    from itertools import combinations

    if len(cuts) <= 8:
        best = max(total(c) for n in range(len(cuts) + 1) for c in combinations(range(len(cuts)), n))
        found = m._spans(text, begin, end)
        got = total([next(k for k, c in enumerate(cuts) if c[1] == a and c[0] == z) for (_, z), (a, _) in zip(found, found[1:])])
        assert abs(got - best) < 1e-9
