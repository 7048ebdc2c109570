import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from leafmill.functions import numbers as N
from leafmill.functions import speech as S
from leafmill.functions import text as T
from leafmill.plans.queries import QUERIES


def values(spark, texts, f):
    rows = [(i, t) for i, t in enumerate(texts)]
    return [r[0] for r in spark.createDataFrame(rows, "i int, t string").select("i", f(F.col("t")).alias("x")).orderBy("i").select("x").collect()]


PARAGRAPHS = [
    (["Am Ufer lagen drei Fischer-", "boote und ein Netz."], "Am Ufer lagen drei Fischerboote und ein Netz."),
    (["Wir lasen das Hand-", "Buch bis zum Morgen."], "Wir lasen das Hand- Buch bis zum Morgen."),
    (["Hinter q dem Hof z steht eine Linde."], "Hinter dem Hof steht eine Linde."),
    (["rt Der Wind drehte gegen Mittag."], "Der Wind drehte gegen Mittag."),
    (["So war es ab da still."], "So war es ab da still."),
    (["Rund 7 % der Ernte % blieben, vom Korn% nichts."], "Rund 7 % der Ernte blieben, vom Korn nichts."),
    (["Am W E G R A N D. Dort blieb er."], "Am WEGRAND. Dort blieb er."),
    (["Sie schrieb l a n g s a m weiter."], "Sie schrieb langsam weiter."),
    (["HERBST AM GROSSEN SEE"], "Herbst Am Grossen See"),
    ([], ""),
    (["", None, "  "], ""),
]


def test_paragraph_text(spark):
    rows = [(i, lines) for i, (lines, _) in enumerate(PARAGRAPHS)]
    got = spark.createDataFrame(rows, "i int, l array<string>").select("i", T.paragraph_text(F.col("l")).alias("x")).orderBy("i").collect()
    assert [r["x"] for r in got] == [want for _, want in PARAGRAPHS]


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (T.collapse_spaced_letters, "Zwei Zeichen X Y sind kein Wort.", "Zwei Zeichen X Y sind kein Wort."),
        (T.collapse_spaced_letters, "M N\nO P\n\nQ R", "M N\nO P\n\nQ R"),
        (T.spoken_german, "Am Abend kam Dr. Holm, auch Dr. Sand.", "Am Abend kam Doktor Holm, auch Doktor Sand."),
        (T.spoken_german, "Unter Dr.phil stand nichts.", "Unter Dr.phil stand nichts."),
        (T.spoken_german, "Vor Notre-Dame lag Schnee.", "Vor Notre Damm lag Schnee."),
        (T.spoken_german, "Ein Notre-Dame-Modell aus Holz.", "Ein Notre-Dame-Modell aus Holz."),
        (T.normalize_upper_heading, "Ein Müller fuhr in die Stadt.", "Ein Müller fuhr in die Stadt."),
        (T.sentences, "Der Hund bellte zweimal im Hof. Danach war Ruhe", ["Der Hund bellte zweimal im Hof.", "Danach war Ruhe"]),
        (T.sentences, "Nein!?", ["Nein!", "?"]),
        (T.sentences, "2.71 ..", ["2.", "71 .", "."]),
        (T.sentences, None, []),
        (T.trailing_fragment, "Gut. so", None),
        (T.trailing_fragment, "Gut. dann", "dann"),
        (T.trailing_fragment, "mitten im Satz", "mitten im Satz"),
        (T.trailing_fragment, "", None),
        (T.tag_id, " ab-1 ", "AB-1"),
        (T.tag_id, "..", None),
        (T.tag_id, "a b", None),
        (T.reader_uid, "e0:04 15", "E00415"),
        (T.is_artifact, "[12]", True),
        (T.is_artifact, "[ab]", False),
        (T.is_quoted_dialogue, "„Wohin des Wegs?“", True),
        (T.collapse_blank_lines, " a \n\n\n\n b ", "a\n\nb"),
        (T.word_count, "ä b's c-d", 3),
        (N.chapter_number, "xiv", 14),
        (N.chapter_number, "12", 12),
        (N.chapter_number, "abc", None),
        (S.plain_speech, '<speak>a<break time="100ms"/>b<break time="0.5s"/>c<break time="2000ms"/>d<break/>e</speak>', "a, b\nc\n\nd\ne"),
        (S.ssml, "", "<speak></speak>"),
        (S.ssml, "Am Fluss\n\nEs regnete. Niemand kam.", "<speak>Am Fluss\n\nEs regnete. Niemand kam.</speak>"),
        (S.ssml, "Salz & Brot.\n\nKapitel neun.\n\nDer Regen kam.", '<speak>Salz &amp; Brot.<break time="1350ms"/>Kapitel neun.<break time="1350ms"/>Der Regen kam.</speak>'),
        (S.ssml, "Kapitel acht.\n\nKapitel neun.\n\nDer Regen kam.", '<speak>Kapitel acht.<break time="1350ms"/>Kapitel neun.<break time="1350ms"/>Der Regen kam.</speak>'),
        (S.enhanced_ssml, "Wer trug den Sack?", '<speak><p><s>Wer trug den <prosody pitch="+3st">Sack</prosody>?</s><break time="2000ms"/></p></speak>'),
        (S.enhanced_ssml, "Das Tor war zu.\n\nIm Hof brannte Licht.", '<speak><p><s>Das Tor war zu.</s><break time="2000ms"/></p><p><s>Im Hof brannte Licht.</s><break time="2000ms"/></p></speak>'),
    ],
)
def test_cases(spark, f, text, want):
    assert values(spark, [text], f) == [want]


def test_enhanced_markup(spark):
    text = "Kapitel neun.\n\nEine lange Reise\n\nDas Schiff lag fest. Alle warteten!\n\n„Wohin geht es?“\nrief der Koch."
    got = values(spark, [text], S.enhanced_ssml)[0]
    assert '<p><s>Das Schiff lag fest.</s><break time="900ms"/><s>Alle warteten!</s><break time="2000ms"/></p>' in got
    assert '<p><s>„Wohin geht es?“ rief der Koch.</s><break time="2000ms"/></p>' in got
    assert '<break time="700ms"/>' in got and '<break time="1350ms"/>' in got


def spaced_model(s):
    """Runs of three or more letters that stand alone, with blanks but no line ends between them, lose these blanks."""
    parts = re.split(r"([^\S\r\n]+)", s)
    tokens, gaps = parts[::2], parts[1::2]
    word = lambda c: c.isalnum() or c == "_"
    ends_alone = lambda t: t[-1:].isalpha() and not (len(t) > 1 and word(t[-2]))
    begins_alone = lambda t: t[:1].isalpha() and not (len(t) > 1 and word(t[1]))
    i = 0
    while i < len(gaps):
        j = i
        while ends_alone(tokens[i]) and j < len(gaps) and (j == i or len(tokens[j]) == 1) and begins_alone(tokens[j + 1]):
            j += 1
        if j - i >= 2:
            gaps[i:j] = [""] * (j - i)
        i = max(j, i + 1)
    return "".join(x for pair in zip(tokens, [*gaps, ""], strict=True) for x in pair)


def fragment_model(s):
    s, end = s.strip(), re.compile(T.PAGE_END)
    if not s or end.search(s[-4:]):
        return None
    return (s[max((m.end() for m in end.finditer(s)), default=0) :].strip()) or None


def segment_model(s):
    """Characters gathered one by one; after a terminator only closers still belong to the sentence."""
    out, now, ended = [], "", False
    for c in " ".join(s.split()):
        if ended and c not in "\"'»«”“)":
            out.append(now)
            now, ended = "", False
        now += c
        ended = ended or c in ".!?"
    return [x.strip() for x in [*out, now] if x.strip()]


@pytest.mark.parametrize(("f", "model", "alphabet"), [(T.collapse_spaced_letters, spaced_model, "ab ä \n1."), (T.trailing_fragment, fragment_model, "ab. !»\"…)"), (T.sentences, segment_model, "ab. !?»\")"), (T.title_case, str.title, "aB'1ä -")])
def test_model(spark, f, model, alphabet):
    rng = random.Random(11)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 24))) for _ in range(1500)]
    assert values(spark, texts, f) == [model(t) for t in texts]


@pytest.mark.parametrize(
    ("text", "sentence_pauses", "paragraph_pauses", "holds"),
    [
        ("»Das Boot ist leer.«\nMaren bindet das Tau an den Pfahl. Ihr Atem\nsteht weiß vor dem Mund.\n»Wo sind die Ruder?«\nNiemand am Steg weiß es.", 3, 2, '<s>Maren bindet das Tau an den Pfahl.</s><break time="900ms"/><s>Ihr Atem steht weiß vor dem Mund.</s><break time="2000ms"/></p>'),
        ("»Wem gehört der Korb?«\n»Ist noch Brot darin?«\n»Leise, der Wächter kommt.«\nAlle duckten sich.", 3, 1, '<s>»Leise, der Wächter kommt.«</s><break time="900ms"/>'),
        ('"Wem gehört der Korb?"\n"Frag den Wirt."\nSpäter war er fort.', 2, 1, "Später war er fort."),
        ("Es taute. War das Eis dünn? Keiner ging!\n\nAm Abend fror es.", 2, 2, '<s>War das Eis <prosody pitch="+3st">dünn</prosody>?</s><break time="900ms"/>'),
        ("Herbst Am Grossen See\n\nEin Müller fuhr in die Stadt.", 0, 1, '<s><emphasis level="moderate">Herbst Am Grossen See</emphasis></s><break time="1350ms"/><p>'),
    ],
)
def test_pauses(spark, text, sentence_pauses, paragraph_pauses, holds):
    got = values(spark, [text], S.enhanced_ssml)[0]
    assert (got.count('<break time="900ms"/>'), got.count('<break time="2000ms"/>')) == (sentence_pauses, paragraph_pauses)
    assert holds in got


def test_announcements(spark):
    assert values(spark, ["Chapter twelve.\n\nRain on the roof."], lambda c: S.ssml(c, "Chapter")) == ['<speak>Chapter twelve.<break time="1350ms"/>Rain on the roof.</speak>']
    assert values(spark, ["Dann schlief der Hof.\n\nKapitel neun.\n\nAm Markt war Lärm."], S.ssml) == ['<speak>Dann schlief der Hof.<break time="1350ms"/>Kapitel neun.<break time="1350ms"/>Am Markt war Lärm.</speak>']


def test_cardinals():
    german, english = N.cardinals("de"), N.cardinals("en")
    assert (german[32], german[101], german[21], german[999]) == ("zweiunddreissig", "einhunderteins", "einundzwanzig", "neunhundertneunundneunzig")
    assert (english[21], english[105], english[700]) == ("twenty-one", "one hundred five", "seven hundred")
    assert len(german) == len(english) == len(set(german)) == 1000


def test_numbers(spark):
    row = spark.range(1).select(
        N.duration(F.lit(2.5)).alias("even"), N.duration(F.lit(100000.0)).alias("long"), N.duration(F.lit(-3.0)).alias("negative"),
        N.scaled_samples(F.array(F.lit(30000), F.lit(-5)), F.lit(2.0), F.lit(16)).alias("samples"), N.ewma(F.array(F.lit(10.0), F.lit(20.0))).alias("ewma"), N.lead_wait(F.lit(5.0), F.lit(1.0), F.lit(1.5)).alias("wait"),
        S.break_seconds(F.lit(" 250 ms")).alias("ms"), T.truncated(F.lit("x" * 100)).alias("cut"),
    ).first()
    assert (row["even"], row["long"], row["negative"]) == ("00:00:02", "27:46:40", "00:00:00")
    assert row["samples"] == [32767, -10] and abs(row["ewma"] - 12.0) < 1e-9 and row["wait"] == 2.5 and row["ms"] == 0.25 and len(row["cut"]) == 96


def collapsed(text):
    """The rule of spaced letters, read off the text character by character."""
    at = lambda i: text[i] if 0 <= i < len(text) else "\n"
    word = lambda c: c.isalnum() or unicodedata.category(c) in ("Mn", "Mc", "Me", "Pc")
    gap = lambda c: c.isspace() and c not in "\r\n\x1c\x1d\x1e\x1f"
    out, i = [], 0
    while i < len(text):
        j = i
        while gap(at(j)):
            j += 1
        if j > i and at(i - 1).isalpha() and at(j).isalpha():
            d, g = j + 1, i - 2
            while gap(at(d)):
                d += 1
            while gap(at(g)):
                g -= 1
            third = not word(at(i - 2)) and d > j + 1 and at(d).isalpha() and not word(at(d + 1))
            first = 1 <= i - 2 - g and at(g).isalpha() and not word(at(g - 1)) and not word(at(j + 1))
            out.append("" if third or first else text[i:j])
        else:
            out.append(text[i:j] or text[i])
        i = max(j, i + 1)
    return "".join(out)


def test_wide_and_long_runs_of_letters(spark):
    wide = "a" + " " * 40 + "b" + " " * 9 + "c x"
    long = " ".join("abcdefgh" * 4000)
    assert values(spark, [wide, long, "a b" + " " * 30 + "cd"], T.collapse_spaced_letters) == ["abcx", "abcdefgh" * 4000, "a b" + " " * 30 + "cd"]


def test_capitals_with_sharp_s(spark):
    assert values(spark, ["GROẞE STRASSE", "DIE STRAßE"], T.normalize_upper_heading) == ["Große Strasse", "DIE STRAßE"]


def test_spaced_letters_of_whole_texts(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r["text"] for r in QUERIES["spaced_letters"](spark, sf).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert max(map(len, texts.values())) > 1000 and got.keys() == texts.keys()
    for i, t in texts.items():
        assert "".join(got[i].split()) == "".join(t.split())
        assert got[i] == collapsed("".join(c + " " if c.isalpha() and d.isalpha() else c for c, d in zip(t, t[1:] + "\n", strict=True)))


def test_white_space_of_all_kinds_is_normal_afterwards(spark):
    """Every character that Python or Unicode calls white space, at the ends, single, doubled and before a blank, against str.split."""
    odd = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and chr(c).isspace()]
    texts = [f"{x}a{x}b {x}c{x} d{x}{x}e  f{x}" for x in odd] + ["", " ", "  ", "a", " a b ", "„a“ – b…  c", "\u200ba\u180e b", "\U0001f600 \U0001f600  x"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.n, r.e, r.w) for r in rows.select("i", T.normalize_space(F.col("t")).alias("n"), T.trim(F.col("t")).alias("e"), T.n_words(T.normalize_space(F.col("t"))).alias("w")).collect()}
    assert got == {i: (" ".join(t.split()), t.strip(), len(t.split())) for i, t in enumerate(texts)}


def test_headings_by_expression_against_words(spark):
    """Headings counted by expressions give what their words, one by one, give."""
    import itertools

    parts = ["Ab", "b", "ÄB", "1a", "1A", "9", "«Z", "ß", "xy", "Éa", "ª", "K", "kr", "IV"]
    texts = [" ".join(x) for n in (1, 2, 3) for x in itertools.product(parts, repeat=n)] + ["", " ", "A  B", "a\u00a0B"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    t, lu, letter = F.col("t"), r"^\p{Lu}", r"\p{L}"
    w = T.words(t)
    lettered = F.filter(w, lambda x: x.rlike(letter))
    cased = (F.size(lettered) >= 2) & F.forall(lettered, lambda x: x.rlike(r"^[^\p{L}]*\p{Lu}"))
    n_letters, capitals = F.length(F.regexp_replace(t, r"[^\p{L}]", "")), F.length(F.regexp_replace(t, r"[^\p{Lu}]", ""))
    shape = (n_letters > 0) & ((capitals * 10 >= n_letters * 8) | ((F.size(w) <= 5) & F.forall(w, lambda x: x.rlike(lu))))
    heading = (F.size(F.filter(w, lambda x: x.rlike(lu))) * 10 >= F.greatest(F.size(w), F.lit(1)) * 6)
    single = F.array_join(F.filter(w, lambda x: ~x.rlike(r"^\p{L}\z")), " ")
    pairs = F.array_join(F.filter(w, lambda x: ~(x.rlike(r"^\p{L}{2}\z") & ~x.rlike(r"[\p{Lu}\p{Lt}]") & x.rlike(r"\p{Ll}") & ~x.rlike(f"[{T.VOWELS}]"))), " ")
    both = [(T.is_title_cased(t), cased), (T.is_heading_shape(t), shape), (T.is_layout_heading(t, F.lit(1)), heading), (T.without_isolated_letters(t), single), (T.without_consonant_pairs(t), pairs)]
    differ = rows.select("t", *[(~a.eqNullSafe(b)).alias(f"d{i}") for i, (a, b) in enumerate(both)])
    assert differ.where("d0 or d1 or d2 or d3 or d4").collect() == []
