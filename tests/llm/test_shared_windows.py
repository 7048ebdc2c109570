"""Decontamination where items share text: a common instruction is no evidence, and rows don't multiply; recall in four languages."""

import random

import pytest
from pyspark.sql import functions as F

from leafmill.llm import decontam

INSTRUCTION = "answer the question below and write down only the final result here"
FILLER = "amber birch cedar dune ember fjord grove heath inlet jetty knoll ledge marsh nook orchard pond quarry ridge slope thicket upland valley willow".split()


def tables(spark, items, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


def test_shared_instruction(spark):
    """300 items with one instruction, 300 documents that hold it and other words, and an exact copy of every tenth item."""
    rng = random.Random(2)
    own = lambda: " ".join(rng.choice(FILLER) + rng.choice(FILLER) for _ in range(10))
    items = [f"{INSTRUCTION} {own()}" for _ in range(300)]
    texts = [f"{own()} {INSTRUCTION} {own()}" for _ in range(300)] + [f"before it {items[k]} and after" for k in range(0, 300, 10)]
    docs, table = tables(spark, items, texts)
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, table).collect()}
    assert got == {(300 + k, 10 * k) for k in range(30)}
    assert decontam.clean(docs, table).count() == 300
    # What documents and items are joined on stays about in proportion to them: no window of evidence stands at more than COMMON places.
    from leafmill.llm.common import Scratch

    scratch = Scratch(spark, "test")
    every = scratch.save(decontam.item_windows(table, "item_id", "text", 8), "windows")
    windows, judged = decontam.evidence(every, decontam.questions_of(every), decontam.COMMON, scratch)
    assert windows.groupBy("size", "literal", "hash").count().agg(F.max("count")).first()[0] <= decontam.COMMON
    assert {len(r["proper"]) for r in judged.collect()} == {10}


def test_items_of_one_template_are_one_question(spark):
    """40 items that differ in a number and a name; a document asks it with a name and a number of its own, another repeats one of them."""
    ask = lambda n, who: f"then the miller told {who} that {n} sacks of grain were left in the barn behind the old church by the river"
    items = [ask(10 + k, ["Anna", "Boris", "Clara"][k % 3]) for k in range(40)]
    docs, table = tables(spark, items, [f"x y {ask(77, 'Greta')} z", f"x y {items[25]} z", "a text about nothing of that kind at all"])
    assert {(r["doc_id"], r["item_id"], r["n_items"]) for r in decontam.leaks(docs, table).collect()} == {(0, 0, 40), (1, 0, 40)}


def test_items_all_of_whose_windows_are_common(spark):
    """Twelve items of the same sentences in another order: every window but those over the seams is common. Exact copies are found, others aren't."""
    rng = random.Random(5)
    sentences = [" ".join(FILLER[k : k + 12]) for k in (0, 5, 10)]
    repeated = " ".join(["alpha beta"] * 12)
    items = [" ".join(rng.sample(sentences, 3)) for _ in range(12)] + [repeated]
    docs, table = tables(spark, items, [f"q {items[0]} r", f"q {sentences[0]} r", f"q {repeated} r", "alpha beta alpha beta"])
    got = {}
    for r in decontam.leaks(docs, table).collect():
        got.setdefault(r["doc_id"], set()).add(r["item_id"])
    assert got.get(0, set()) >= {items.index(items[0])} and 2 in got and got[2] == {12} and 1 not in got and 3 not in got


# Words of each language for planted questions, with names, numbers and units as they are written there.
LANGUAGES = {
    "de": ("danach lief er langsam über den kleinen weg und trug etwas wasser mit sich weil es dort unten sehr warm war".split(), "Jürgen Änne Björn Käthe".split(), "vier neun zwölf 25".split(), "Meter Stunden Kilogramm Minuten".split()),
    "fr": ("ensuite il marchait lentement sur le petit chemin avec de l eau parce que tout était déjà très chaud là bas".split(), "Élodie Étienne Zoé Hélène".split(), "quatre neuf douze 25".split(), "mètres heures kilos minutes".split()),
    "es": ("luego caminaba despacio por el pequeño sendero con algo de agua porque allá abajo hacía ya mucho calor".split(), "Íñigo Óscar Begoña Ángel".split(), "cuatro nueve doce 25".split(), "metros horas kilos minutos".split()),
    "en": ("then he walked slowly over the little path and carried some water because it was very warm down there".split(), "Anna Boris Clara Dmitri".split(), "four nine twelve 25".split(), "metres hours kilograms minutes".split()),
}


@pytest.mark.parametrize("language", sorted(LANGUAGES))
def test_recall_and_precision(spark, language):
    """Of 40 planted questions with other values nine in ten at least are found, and none in texts of the same words."""
    words, names, numbers, units = LANGUAGES[language]
    rng = random.Random(language)
    asks = []
    for _ in range(40):
        plan = ["word", *(rng.choices(("word", "name", "number", "unit"), (7, 1, 1, 1))[0] for _ in range(rng.randint(18, 36)))]
        fixed, ids = [rng.choice(words) for _ in plan], [rng.randrange(3) for _ in plan]

        def ask(plan=plan, fixed=fixed, ids=ids):
            pick = {"name": rng.sample(names, 3), "number": rng.sample(numbers, 3), "unit": rng.sample(units, 3)}
            return " ".join(w if kind == "word" else pick[kind][k] for kind, w, k in zip(plan, fixed, ids, strict=True))

        asks.append(ask)
    items = [a() for a in asks]
    texts = [f"etwas davor. {a()} etc" for a in asks] + [" ".join(w for _ in range(6) for w in rng.sample(items[k].split(), 6)) for k in range(40)]
    found = {}
    docs, table = tables(spark, items, texts)
    for r in decontam.leaks(docs, table).collect():
        found.setdefault(r["doc_id"], set()).add(r["item_id"])
    assert sum(k in found.get(k, ()) for k in range(40)) >= 36
    assert not any(found.get(k) for k in range(40, 80))


def test_placeholders_of_names_and_words():
    import pyarrow as pa

    text = "so Élodie and Ñandú met Žofie; Äpfel: zwölf, quatre, nueve and nine mètres"
    tokens = decontam.Tokens.of(pa.array([text]))
    kinds = {int(decontam.NAME): "name", int(decontam.NUMBER): "number", int(decontam.UNIT): "unit"}
    got = [kinds.get(int(t), "") for t in tokens.template]
    assert got == ["", "name", "", "name", "", "name", "name", "number", "number", "number", "", "number", "unit"]
