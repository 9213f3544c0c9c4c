import math
import random
import re
import textwrap

from docs import frame, odd_documents, shaped

from limnos.llm import license_scan as ls


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text):
    w = words(text)
    places, base = [], set()
    for phrase, label in ls.PHRASES.items():
        v = phrase.split()
        for i in range(len(w) - len(v) + 1):
            if w[i : i + len(v)] == v:
                places.append(i)
                base.add(label)
    added, share = set(), 0.0
    for name, template in ls.TEMPLATES.items():
        v = set(words(template))
        must, never = map(set, ls.MARKS.get(name, ([], [])))
        width = math.ceil(len(words(template)) / ls.THRESHOLD - 1e-9)
        for i in range(len(w)):
            held = set(w[i : i + width])
            got = len(v & held) / len(v)
            if got >= ls.THRESHOLD - 1e-9 and must <= held and not never & set(w[max(0, i - ls.REACH) : i + width + ls.REACH]):
                added.add(name)
                share = max(share, got)
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | added)), 1.0 if places else share)


def rows():
    texts = [
        "Released Under the MIT\nLicense. under the mit license; UNDER THE MIT LICENSE",
        "Licensed under the Apache License, Version 2.0.",
        "x\n" + ls.TEMPLATES["gpl"].upper() + "\ny cc-by-nc cc by nc",
        ls.TEMPLATES["bsd"].replace("following", "next") + " extra words here",
        " ".join(ls.TEMPLATES["isc"].split()[:12]),
        ls.TEMPLATES["mit"].replace(" ", "\n"),
        "the Kelvin sign K mit İ license",
        "<under><the><mit><license> under the mit licenses",
    ]
    return odd_documents(n=30) + [(500 + i, t, None, None, None, None, None) for i, t in enumerate(texts)]


def test_matches_brute_force(spark):
    got = ls.scan(frame(spark, rows())).collect()
    want = [(r[0], *brute(r[1])) for r in rows()]
    near = lambda rs: shaped((*r[:7], round(r[7], 9)) for r in rs)
    assert near(got) == near(want)
    assert sum(bool(r.labels) for r in got) >= 6


def test_wrapped_notices_and_rivals(spark):
    wrap = lambda text, mark="": "\n".join(mark + line for line in textwrap.wrap(text, 62))
    t = ls.TEMPLATES
    texts = {
        "mit": "some code\n" + wrap(t["mit"], " * ") + "\nmore",
        "isc": wrap(t["isc"], "# "),
        "gpl": wrap(t["gpl"]),
        "lgpl": "This program is free software: you can redistribute it and/or modify it\n" + wrap(t["lgpl"]),
        "agpl": wrap(t["gpl"].replace("GNU General", "GNU Affero General") + " as published by the Free Software Foundation"),
        "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "cc-by-nc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "cc-by-nc-sa": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 License.",
        "cc-by-sa": "Licensed under a\nCreative Commons Attribution-ShareAlike\n4.0 License",
        "": "permission to park is hereby granted to any person without fee",
    }
    rows = [(k, text, None, None, None, None, None) for k, text in enumerate(texts.values())]
    got = {r.doc_id: r.labels for r in ls.scan(frame(spark, rows)).collect()}
    assert got == dict(enumerate(texts))


def test_strewn_words_are_no_notice_and_narrow_ones_are(spark):
    rng = random.Random(2)
    other = lambda k: " ".join(rng.choice(["water", "lake", "gauge", "level"]) for _ in range(k))
    strewn = lambda text, k: " ".join(w + " " + other(k) for w in text.split())
    texts = [
        strewn(ls.TEMPLATES["mit"], 20),
        "this " + other(130) + " is free " + other(130) + " and software released into " + other(130) + " the public domain",
        "\n".join(textwrap.wrap(ls.TEMPLATES["mit"], 24)),
        other(500) + " " + ls.TEMPLATES["mit"] + " " + other(500),
        "free " * 3000 + ls.TEMPLATES["isc"],
    ]
    assert len(texts[2].split("\n")) >= 6
    got = {r.doc_id: (r.labels, r.score) for r in ls.scan(frame(spark, [(k, t, *[None] * 5) for k, t in enumerate(texts)])).collect()}
    assert got == {0: ("", 0.0), 1: ("", 0.0), 2: ("mit", 1.0), 3: ("mit", 1.0), 4: ("isc", 1.0)}


def test_no_python_on_the_main_path(spark):
    plan = ls.scan(frame(spark, rows()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_table(spark):
    assert ls.scan(frame(spark, [])).count() == 0
