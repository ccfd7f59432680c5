"""Leaks of re-parameterised questions against a plain search by template, and how questions that are merely alike fare."""

import random
import re

import pytest

from courierlake.llm import decontaminate

NAMES = ["Boston", "Lisbon", "Madrid", "Oslo", "Turin", "Kyoto", "Quito", "Accra"]
PEOPLE = ["Ann", "Bob", "Cid", "Dora", "Eve", "Finn", "Gus", "Hana"]
TEMPLATES = [
    "If a train leaves {a} at {n} km per hour and {m} minutes later it stops, how long did the driver {p} need to reach the station of the town?",
    "The shop of {p} sells {n} apples and {m} pears on the first day of the week, so how many of them are left when {p} closes it in the evening?",
    "A farmer near {a} keeps {n} sheep in the upper field and sends {m} of them to the market, what part of the herd stays with the farmer over the winter?",
    "Which of the {n} rivers that flow past {a} is longer than {m} km and still carries ships as {p} wrote in the old letter to the king?",
]
FILLER = "the people of the valley spoke of it for years and nobody could say who had been right about the old road over the hills".split()


def filled(rng, template):
    return template.format(a=rng.choice(NAMES), n=rng.randrange(2, 90), m=rng.randrange(2, 90), p=rng.choice(PEOPLE))


def prose(rng, n):
    return " ".join(rng.choice(FILLER) for _ in range(n))


def plain_templates(text):
    """The text with numbers and names as marks, in plain Python."""
    return re.sub(r"\b(?:" + "|".join(NAMES + PEOPLE) + r")\b", "P", re.sub(r"\d+", "N", text)).lower()


@pytest.fixture(scope="module")
def made():
    rng = random.Random(8)
    items = [(i, filled(rng, TEMPLATES[i % 3])) for i in range(300)]  # the fourth template is in no item
    docs, leak = [], {}
    for d in range(240):
        k = d % 6
        question = filled(rng, TEMPLATES[k]) if k < 4 else "If a train leaves the yard late nobody minds, and the shop of the miller sells bread" if k == 4 else ""
        docs.append((d, f"{prose(rng, 30)}. {question} {prose(rng, 30)}."))
        if k < 3:
            leak[d] = k
    return items, docs, leak


def test_variants_are_one_class(spark, made):
    items, docs, leak = made
    bench, table = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    classes = {}
    for r in decontaminate.template_classes(bench).collect():
        classes.setdefault(r["class_item"], set()).add(r["item_id"])
    # the shop's template names one person twice, the others none: slots that repeat are part of a class
    same = {}
    for i, text in items:
        words = re.findall(r"\d+|\b(?:" + "|".join(NAMES + PEOPLE) + r")\b", text)
        same.setdefault((plain_templates(text), tuple(words.index(w) for w in words)), set()).add(i)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, same.values()))
    got = decontaminate.leaks(table, bench).collect()
    found = {r["doc_id"] for r in got}
    assert found == set(leak)  # all re-parameterised questions, none that is merely alike, no prose
    assert all(min(classes[r["item_id"]]) == r["item_id"] and r["n_items"] == len(classes[r["item_id"]]) for r in got)
    assert all(r["item_id"] % 3 == leak[r["doc_id"]] for r in got)
    # rows go by documents and classes, not by documents and items
    assert len(got) <= len(leak) * max(sum(min(c) % 3 == k for c in classes.values()) for k in range(3))


def test_one_template_in_many_documents(spark):
    rng = random.Random(9)
    template = "So a merchant from the coast buys {n} sacks of flour for the bakers and loses some of them on the way over the mountains"
    items = [(i, template.format(n=i + 2)) for i in range(400)]
    docs = [(d, f"{prose(rng, 20)}. {template.format(n=5000 + d)} {prose(rng, 20)}") for d in range(400)]
    docs[0] = (0, f"{prose(rng, 20)}. {template.format(n=7)} {prose(rng, 20)}")
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["n_items"]) for r in got) == [(d, 0, 400) for d in range(400)]


ALIKE = [  # question, text, whether it is held for a leak
    ("What is the capital of France and how many people live there today?", "what is the capital of Norway and how many sheep are in the hills around it", True),
    ("What is the capital of France and how many people live there today?", "they asked what the capital of Norway is, and nobody knew", False),
    ("How many of the 14 red stones did the old miller of the valley keep for the winter that year?", "How many of the 14 blue boats did the young fisher of the coast lose in the storm that day?", False),
    ("the end of the", "it was the end of the day", True),
]


@pytest.mark.parametrize("question, text, held", ALIKE)
def test_questions_that_are_alike(spark, question, text, held):
    docs, bench = spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(2, question)], "item_id long, text string")
    assert (decontaminate.leaks(docs, bench).count() == 1) == held
