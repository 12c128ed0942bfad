"""Small tables that hold the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, host string, size long, slot long, toxic int, score double, ids string, label string"
SF = "/root/testdata/sf0.001"

TEXTS = [
    None,
    "",
    "   \n\t ",
    "one two three four five six one two three four",
    "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3,
    "Same line here.\nSame line here.\n\nother # line | with * symbols",
    "Licensed under the Apache License, Version 2.0. All rights reserved. CC-BY and cc by; general public license",
    "mail a.b@c.de%x@y.org, call +1 (555) 123-4567 or +49 30 1234567890123456 from 10.0.0.1, 300.1.1.1 and 1.2.3.4.5.6.7.8",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112 and 5555555555554444 x@y a@b.c-",
    "é ▁ ñ  漢字 \U0001f600 tab\there ümlaut",
    "word " * 3000,
    "long" * 20000,
]


def documents(spark):
    rows = [(i, t, "en", ["b", "a", None][i % 3], 0) for i, t in enumerate(TEXTS)]
    rows += [(3, TEXTS[3], "en", "b", 0), (3, TEXTS[3], "en", "b", 0), (None, "a null id " * 20, None, None, None), (50, TEXTS[4] + " tail", "en", "a", 1)]
    return spark.createDataFrame([(*r, "x", 1, 1, 1, 0.5, "i", "l") for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
