"""License scans in DataFrame functions: a positional index of licence words.

The index lists, for each word of a licence notice outside its key phrases, the notices and
positions where it stands. For each notice a file looks up those of its words that are rarest
over all files, at most ``RAREST``; their positions less those in the notice are intersected,
and a notice is taken where enough of them agree on one relative position and all its key
phrases stand in the file. A key phrase alone brings no rare word, so it gives no label. The
index and the counts of its words over all files are bounded by the notices.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.operators.blocks import column

from .exchange import any_names, free, others
from .quality import let

#: Labels of the base phrases.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Fixed values: (label, notice, mandatory key phrases), in the words of the public licences.
TEMPLATES = (
    ("mit-notice", "released under the mit license", ("mit license",)),
    ("mit-notice", "licensed under the mit license", ("mit license",)),
    ("mit-notice", "distributed under the terms of the mit license", ("mit license",)),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at apache license version 2 0", ("apache license version 2 0",)),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("general public license version 3",)),
    (
        "gpl-3.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license",
        ("general public license", "version 3 of the license"),
    ),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2", ("general public license version 2",)),
    (
        "gpl-2.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license",
        ("general public license", "version 2 of the license"),
    ),
    ("lgpl", "under the terms of the gnu lesser general public license", ("lesser general public license",)),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    *(
        (f"cc-{kind}-4.0", f"{how} under cc {kind.replace('-', ' ')} 4 0", (f"cc {kind.replace('-', ' ')} 4 0",))
        for kind in ("by-nc", "by", "by-sa")
        for how in ("licensed", "available", "shared", "released")
    ),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
)
#: Words of a notice that a file looks up at most, and the share of them, or of all if a notice has fewer, that must agree.
RAREST, SHARE = 8, 0.75
#: Words of so many characters are rare enough to choose files by.
LONG = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def hint(phrases: Iterable[str]) -> str:
    """A pattern that every lower-cased text with one of the phrases matches: a word of each, one that many have, or if all its words are short the phrase."""
    parts = [p.split() for p in phrases]
    often = Counter(w for p in parts for w in set(p))
    found = set()
    for words in parts:
        word = max(words, key=lambda w: (len(w) >= LONG, often[w], len(w)))
        found.add(re.escape(word) if len(word) >= LONG else NOT_WORD.join(map(re.escape, words)))
    return "|".join(sorted(found)) or "(?!)"


def _starts(words: Column, phrase: str) -> Column:
    """Positions at which the phrase's words stand one after another."""
    parts = phrase.split()

    def here(w: Column, i: Column) -> Column:
        ok = w == parts[0]
        for k, part in enumerate(parts[1:], 1):
            ok = ok & F.coalesce(F.get(words, i + k) == part, F.lit(False))
        return F.when(ok, i.cast("long"))

    return F.filter(F.transform(words, here), lambda i: i.isNotNull())


def _labelled(starts: Column, label: str) -> Column:
    return F.transform(starts, lambda i: F.struct(i.alias("i"), F.lit(label).alias("label")))


def evidence(notice: str, keys: Iterable[str]) -> list[tuple[str, int]]:
    """(word, position) of a notice's words that stand in none of its key phrases."""
    held = {w for k in keys for w in k.split()}
    found = [(w, k) for k, w in enumerate(notice.split()) if w not in held]
    if not found:
        raise ValueError(f"a notice needs words beside its key phrases: {notice}")
    return found


@any_names
def license_scan(docs: DataFrame, id: str = "doc_id", text: str = "text", templates=TEMPLATES, phrases=PHRASES, rarest: int = RAREST, share: float = SHARE) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels and score of each row.

    score: the largest share of a taken notice's looked-up words that agree on one position; at
    least 0.5 where a base phrase stands; 0 without a label. How rare a word is comes from the
    files of docs, ties by the word. Null and empty texts have no words, labels "" and score 0.
    Equal rows get equal results, whatever their ids; a long text's words are one array. Files are
    known by two 64-bit hashes of id and text. Columns of docs named like the new ones, whatever
    their case, are replaced. An empty table gives an empty result.
    """
    new = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    rest = [column(c) for c in others(docs, new)]
    key, places, words, base_labels, more, best = free(docs, "_file", "_places", "_words", "_base", "_more", "_best")
    value = F.coalesce(column(text).cast("string"), F.lit(""))
    low = F.translate(value, UPPER, LOWER)
    split = F.filter(F.split(low, NOT_WORD), lambda w: w != "")
    hinted = low.rlike(hint([*phrases, *(p for _, _, keys in templates for p in keys)]))
    own = column(id).cast("string")
    file = F.struct(F.xxhash64(own, value).alias("a"), F.xxhash64(value, own, F.lit(1)).alias("b"))

    found = let(split, lambda w: F.flatten(F.array(*(_labelled(_starts(w, p), label) for p, label in phrases.items()))))
    base = docs.select(*rest, file.alias(key), F.coalesce(F.regexp_count(value, F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"), F.when(hinted, found).alias(places))
    base = base.withColumns(
        {
            "n_base": F.when(F.col(places).isNull(), 0).otherwise(F.size(places)).cast("long"),
            "first_word": F.array_min(F.col(f"{places}.i")),
            "last_word": F.array_max(F.col(f"{places}.i")),
            base_labels: F.coalesce(F.array_sort(F.array_distinct(F.col(f"{places}.label"))), F.array().cast("array<string>")),
        }
    )

    index = [(word, t, k) for t, (_, notice, keys) in enumerate(templates) for word, k in evidence(notice, keys)]
    vocabulary = sorted({w for w, _, _ in index})
    seen = docs.select(F.explode(F.array_intersect(split, F.array(*map(F.lit, vocabulary)))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    often = {r.w: r.n for r in seen.collect()}  # at most as many rows as the notices have words
    by_rarity = [sorted({w for w, u, _ in index if u == t}, key=lambda w: (often.get(w, 0), w)) for t in range(len(templates))]
    whole = [min(rarest, len(x)) for x in by_rarity]

    line = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    stand = [F.when(F.array(*(F.contains("line", F.lit(f" {p} ")) for p in keys)) == F.array(*(F.lit(True) for _ in keys)), F.lit(t)) for t, (_, _, keys) in enumerate(templates)]
    files = docs.where(hinted).select(file.alias("file"), split.alias("words")).withColumn("line", line)
    files = files.select("file", "words", F.array_compact(F.array(*stand)).alias("keys"), F.array_intersect("words", F.array(*map(F.lit, vocabulary))).alias("present"))
    looked = F.array(*(F.slice(F.filter(F.array(*map(F.lit, x)), lambda w: F.array_contains("present", w)), 1, rarest) for x in by_rarity))
    files = files.where(F.size("keys") > 0).withColumn("looked", looked)
    hits = files.select("file", "keys", "looked", F.array_distinct(F.flatten("looked")).alias("any"), F.posexplode("words").alias("pos", "w")).where(F.array_contains("any", F.col("w")))
    postings = docs.sparkSession.createDataFrame(index, "w string, t int, k int")
    votes = hits.join(F.broadcast(postings), "w").where(F.array_contains(F.get("looked", F.col("t")), F.col("w")))
    agreed = votes.groupBy("file", "t", (F.col("pos") - F.col("k")).alias("at")).agg(F.count_distinct("w").alias("n"), F.first("keys").alias("keys"))
    of = lambda values: F.create_map(*[F.lit(x) for t, v in enumerate(values) for x in (t, v)])[F.col("t")]
    taken = agreed.where((F.col("n") >= of([math.ceil(share * n) for n in whole])) & F.array_contains("keys", F.col("t")))
    taken = taken.groupBy(F.col("file").alias(key)).agg(F.collect_set(of([name for name, _, _ in templates])).alias(more), F.max(F.col("n") / of(whole)).alias(best))
    out = base.join(taken, key, "left")
    labels = F.array_sort(F.array_union(base_labels, F.coalesce(more, F.array().cast("array<string>"))))
    score = F.greatest(F.coalesce(best, F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0))
    return out.select(*rest, "n_words", "n_base", "first_word", "last_word", F.array_join(base_labels, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def sql(table: str = "documents", id: str = "doc_id", text: str = "text") -> str:
    """The same as DuckDB SQL, by way of all places and all offsets."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = lambda rows: ", ".join("(" + ", ".join(quoted(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    base = values((p, label) for p, label in PHRASES.items())
    keys = values((t, p) for t, (_, _, phrases) in enumerate(TEMPLATES) for p in phrases)
    posts = values((t, w, k) for t, (_, notice, phrases) in enumerate(TEMPLATES) for w, k in evidence(notice, phrases))
    sizes = [min(RAREST, len({w for w, _ in evidence(notice, phrases)})) for _, notice, phrases in TEMPLATES]
    names = values((t, name, len(phrases), sizes[t], math.ceil(SHARE * sizes[t])) for t, (name, _, phrases) in enumerate(TEMPLATES))
    return rf"""WITH words AS (SELECT {id}, row_number() OVER () AS r, [x FOR x IN string_split_regex(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{NOT_WORD}') IF x <> ''] AS w FROM {table}),
near AS (SELECT r, w, ' ' || array_to_string(w, ' ') || ' ' AS line FROM words),
base AS (SELECT r, i, label FROM (SELECT r, w, p, label, unnest(range(len(w))) AS i FROM near, (VALUES {base}) b(p, label) WHERE contains(line, ' ' || p || ' ')) WHERE w[i + 1 : i + len(string_split(p, ' '))] = string_split(p, ' ')),
places AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM base GROUP BY r),
names AS (SELECT * FROM (VALUES {names}) n(t, name, phrases, size, need)), posts AS (SELECT * FROM (VALUES {posts}) p(t, w, k)),
often AS (SELECT w, count(*) AS n FROM (SELECT DISTINCT r, unnest(w) AS w FROM words) WHERE w IN (SELECT w FROM posts) GROUP BY w),
keyed AS (SELECT r, t FROM near, (VALUES {keys}) k(t, p) JOIN names USING (t) WHERE contains(line, ' ' || p || ' ') GROUP BY r, t, phrases HAVING count(*) = phrases),
hits AS (SELECT r, t, unnest(w) AS w, unnest(range(len(w))) AS i FROM keyed JOIN near USING (r)),
looked AS (SELECT r, t, w FROM (SELECT DISTINCT r, t, w FROM hits JOIN (SELECT DISTINCT t, w FROM posts) USING (t, w)) JOIN often USING (w) QUALIFY row_number() OVER (PARTITION BY r, t ORDER BY n, w) <= {RAREST}),
agreed AS (SELECT r, t, i - k AS at, count(DISTINCT w) AS n FROM hits JOIN looked USING (r, t, w) JOIN posts USING (t, w) GROUP BY ALL),
taken AS (SELECT r, list(DISTINCT name) AS more, max(n::DOUBLE / size) AS best FROM agreed JOIN names USING (t) WHERE n >= need GROUP BY r)
SELECT {id}, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word, coalesce(array_to_string(labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(labels, []), coalesce(more, [])))), ','), '') AS labels, greatest(coalesce(best, 0.0), CASE WHEN n_base > 0 THEN 0.5 ELSE 0.0 END)::DOUBLE AS score
FROM words LEFT JOIN places USING (r) LEFT JOIN taken USING (r)"""
