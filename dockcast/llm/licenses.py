"""License scans with DataFrame functions only: ordered signature rules.

A text is lower-cased (A-Z), its words (0-9, a-z, non-ASCII) are joined by single
blanks, and every rule whose keyword occurs is matched as a regular expression on
whole words.  Detections are word intervals; one that lies inside another (longer,
or equal and of higher priority) is suppressed.  Three base phrases are always
reported, whatever the rules say.
"""

from __future__ import annotations

import json
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockcast.llm.text import NOT_ALNUM, count_words, single_blanks

# fixed values: base phrases and their labels
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

_LIC = "licen[cs]e"
_UNDER = "(?:licen[cs]ed|released|distributed|available|published|provided|made available) (?:to you )?under (?:the )?(?:terms of (?:the )?)?"

# label, keyword, name as a pattern; forms below turn each into several rules
NAMES = (
    ("apache-2.0", "apache", "apache (?:software )?licen[cs]e (?:version |v)?2(?: 0)?"),
    ("apache-1.1", "apache", "apache (?:software )?licen[cs]e (?:version |v)?1 1"),
    ("apache", "apache", "apache (?:software )?licen[cs]e"),
    ("mit", "licen", "mit(?: x11)? licen[cs]e"),
    ("mit-0", "no attribution", "mit no attribution(?: licen[cs]e)?"),
    ("bsd-2-clause", "bsd", "(?:simplified bsd|bsd 2 clause|2 clause bsd|freebsd)(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd", "(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd)(?: licen[cs]e)?"),
    ("bsd-4-clause", "bsd", "(?:original bsd|bsd 4 clause|4 clause bsd)(?: licen[cs]e)?"),
    ("bsd", "bsd", "bsd(?: style)? licen[cs]e"),
    ("isc", "licen", "isc licen[cs]e"),
    ("gpl-1.0", "general", "(?:gnu )?general public licen[cs]e(?: as published by the free software foundation)? (?:version |v)1"),
    ("gpl-2.0", "general", "(?:gnu )?general public licen[cs]e(?: as published by the free software foundation)? (?:version |v)2"),
    ("gpl-3.0", "general", "(?:gnu )?general public licen[cs]e(?: as published by the free software foundation)? (?:version |v)3"),
    ("gpl-2.0", "gpl", "(?:gnu )?gpl ?v?2(?: 0)?"),
    ("gpl-3.0", "gpl", "(?:gnu )?gpl ?v?3(?: 0)?"),
    ("gpl", "gnu", "gnu (?:gpl|general public licen[cs]e)"),
    ("lgpl-2.1", "lesser", "(?:gnu )?lesser general public licen[cs]e (?:version |v)2 1"),
    ("lgpl-3.0", "lesser", "(?:gnu )?lesser general public licen[cs]e (?:version |v)3"),
    ("lgpl", "lesser", "(?:gnu )?lesser general public licen[cs]e"),
    ("lgpl-2.0", "library", "(?:gnu )?library general public licen[cs]e"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl(?: ?v?[23](?: [01])?)?"),
    ("agpl-3.0", "affero", "(?:gnu )?affero general public licen[cs]e(?: (?:version |v)3)?"),
    ("agpl-3.0", "agpl", "(?:gnu )?agpl(?: ?v?3(?: 0)?)?"),
    ("fdl", "documentation", "(?:gnu )?free documentation licen[cs]e(?: (?:version |v)?1 [0-3])?"),
    ("mpl-1.1", "mozilla", "mozilla public licen[cs]e (?:version |v)?1 [01]"),
    ("mpl-2.0", "mozilla", "mozilla public licen[cs]e (?:version |v)?2(?: 0)?"),
    ("mpl", "mozilla", "mozilla public licen[cs]e"),
    ("epl-1.0", "eclipse", "eclipse public licen[cs]e(?: (?:version |v))? ?1(?: 0)?"),
    ("epl-2.0", "eclipse", "eclipse public licen[cs]e(?: (?:version |v))? ?2(?: 0)?"),
    ("epl", "eclipse", "eclipse public licen[cs]e"),
    ("cddl-1.0", "development and distribution", "common development and distribution licen[cs]e"),
    ("cpl-1.0", "common public", "common public licen[cs]e"),
    ("eupl", "european", "european union public licen[cs]e(?: (?:version |v)?1 [0-2])?"),
    ("artistic-2.0", "artistic", "(?:perl )?artistic licen[cs]e (?:version |v)?2(?: 0)?"),
    ("artistic-1.0", "artistic", "(?:perl )?artistic licen[cs]e"),
    ("boost-1.0", "boost", "boost software licen[cs]e(?: (?:version |v)?1(?: 0)?)?"),
    ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e"),
    ("unlicense", "unlicense", "(?:the )?unlicense"),
    ("wtfpl", "fuck you want", "do what the fuck you want to public licen[cs]e"),
    ("odbl-1.0", "database", "open (?:data commons open )?database licen[cs]e"),
    ("odc-by-1.0", "commons", "open data commons attribution licen[cs]e"),
    ("pddl-1.0", "public domain", "public domain dedication and licen[cs]e"),
    ("ofl-1.1", "open font", "(?:sil )?open font licen[cs]e(?: (?:version |v)?1 [01])?"),
    ("psf-2.0", "python", "python software foundation licen[cs]e"),
    ("ms-pl", "microsoft", "microsoft public licen[cs]e"),
    ("ms-rl", "microsoft", "microsoft reciprocal licen[cs]e"),
    ("ogl-uk", "government", "open government licen[cs]e(?: v?[123](?: 0)?)?"),
    ("postgresql", "postgresql", "postgresql licen[cs]e"),
    ("openssl", "openssl", "openssl licen[cs]e"),
    ("php-3.01", "licen", "php licen[cs]e"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)? licen[cs]e"),
    ("afl-3.0", "academic free", "academic free licen[cs]e"),
    ("osl-3.0", "open software", "open software licen[cs]e"),
    ("upl-1.0", "universal permissive", "universal permissive licen[cs]e"),
    ("openrail", "rail", "(?:creativeml )?open ?rail(?: ?\\+?m)?(?: licen[cs]e)?"),
)

# forms: pattern around the name, weight; a longer form wins by containment
FORMS = (
    ("{n}", 0.8),
    (_UNDER + "{n}", 0.98),
    ("subject to (?:the )?(?:terms of )?(?:the )?{n}", 0.95),
    ("(?:governed|covered) by (?:the )?{n}", 0.95),
)

# label, keyword, pattern, weight: signatures that are no plain names
SIGNATURES = (
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy", 1.0),
    ("mit", "warranty", "the software is provided as is without warranty of any kind express or implied", 0.9),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 1.0),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted", 1.0),
    ("bsd-3-clause", "endorse", "neither the names? of .{1,80}? nor the names of its contributors may be used to endorse or promote products", 1.0),
    ("bsd-4-clause", "acknowledg", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 1.0),
    ("zlib", "altered", "altered source versions must be plainly marked as such", 1.0),
    ("unlicense", "public domain", "this is free and unencumbered software released into the public domain", 1.0),
    ("gpl", "free software", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e", 1.0),
    ("gpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e", 0.98),
    ("lgpl", "library", "this library is free software you can redistribute it and or modify it", 1.0),
    ("apache-2.0", "compliance", "you may not use this file except in compliance with the licen[cs]e", 0.95),
    ("mpl-2.0", "source code form", "this source code form is subject to the terms of the mozilla public licen[cs]e", 1.0),
    ("boost-1.0", "boost", "distributed under the boost software licen[cs]e", 1.0),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?", 0.95),
    ("cc0-1.0", "waived", "has waived all copyright and related (?:or|and) neighboring rights", 1.0),
    ("public-domain", "public domain", "(?:in|into|to|released to|dedicated to) the public domain", 0.8),
    ("public-domain", "public domain", "public domain(?: mark| dedication)?", 0.6),
    ("reserved", "rights", "all rights reserved(?: worldwide)?", 0.9),
    ("some-rights-reserved", "rights", "some rights reserved", 0.7),
    ("no-rights-reserved", "rights", "no rights reserved", 0.8),
    ("copyright", "copyright", "copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?", 0.5),
    ("copyright", "copr", "copr (?:19|20)[0-9]{2}", 0.5),
    ("proprietary", "proprietary", "(?:proprietary and confidential|confidential and proprietary)", 0.9),
    ("proprietary", "reproduc", "(?:no part of this .{1,40}? may be reproduced|may not be reproduced) (?:in any form )?without (?:the )?(?:prior )?(?:written )?permission", 0.95),
    ("proprietary", "unauthori", "unauthori[sz]ed (?:copying|reproduction|use|distribution)(?: or (?:copying|reproduction|use|distribution))? .{0,40}?(?:is )?(?:strictly )?prohibited", 0.9),
    ("commercial", "commercial", "commercial licen[cs]e (?:is )?(?:required|available)", 0.8),
    ("non-commercial", "commercial", "(?:for )?non ?commercial (?:use|purposes) only", 0.85),
    ("non-commercial", "commercial", "not for commercial use", 0.85),
    ("research-only", "research", "(?:for )?research (?:use|purposes) only", 0.85),
    ("evaluation-only", "evaluation", "(?:for )?evaluation (?:use|purposes) only", 0.85),
    ("personal-only", "personal", "(?:for )?personal (?:use|purposes) only", 0.85),
    ("eula", "agreement", "end user licen[cs]e agreement", 0.9),
    ("spdx", "spdx", "spdx licen[cs]e identifier [0-9a-z]+(?: [0-9a-z]+){0,3}", 1.0),
    ("permission", "permission", "(?:used|reprinted|reproduced) (?:with|by) permission", 0.7),
    ("warranty-disclaimer", "warrant", "without (?:any )?warrant(?:y|ies) (?:or conditions )?of any kind", 0.6),
    ("trademark", "trademark", "(?:are|is a)(?: registered)? trademarks? of", 0.5),
    ("fair-use", "fair use", "fair use", 0.5),
    ("open-access", "open access", "open access (?:article|paper)? ?(?:distributed )?under", 0.8),
)


def _creative_commons() -> list[tuple]:
    """One rule per element set, version and wording."""
    elements = {
        "by": ("by", "attribution"),
        "by-sa": ("by sa", "attribution share ?alike"),
        "by-nc": ("by nc", "attribution non ?commercial"),
        "by-nd": ("by nd", "attribution no ?derivatives"),
        "by-nc-sa": ("by nc sa", "attribution non ?commercial share ?alike"),
        "by-nc-nd": ("by nc nd", "attribution non ?commercial no ?derivatives"),
    }
    out = []
    for key, (short, name) in elements.items():
        for v in ("1 0", "2 0", "2 5", "3 0", "4 0", ""):
            label = f"cc-{key}-{v.replace(' ', '.')}".rstrip("-")
            tail = f" (?:v|version )?{v}(?: international| unported| generic)?" if v else ""
            # a keyword is any text that each match must hold; the rarer, the better
            out.append((label, f"cc {short}", f"cc {short}{tail}", 0.9))
            out.append((label, f"cc {short}", f"{_UNDER}(?:an? )?cc {short}{tail}(?: {_LIC})?", 0.98))
            out.append((label, "creative commons", f"creative commons {name}(?: {_LIC})?{tail}(?: {_LIC})?", 0.95))
            out.append((label, "creativecommons org", f"creativecommons org {_LIC}s {short}{tail}", 1.0))
    return out


def rules() -> list[dict]:
    """The ordered rules; a smaller priority wins between equal intervals."""
    rows = [(label, kw, form.replace("{n}", name), w) for label, kw, name in NAMES for form, w in FORMS]
    rows = [*SIGNATURES, *_creative_commons(), *rows]
    return [
        # whole words: a blank or an end on both sides
        {"prio": i, "label": label, "kw": kw, "re": f"(?<![^ ])(?:{pat})(?![^ ])", "w": w}
        for i, (label, kw, pat, w) in enumerate(rows)
    ]


def _blanks(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda acc, x: acc + _blanks(x))


def _places(norm: Column, rule: Column) -> Column:
    """Word intervals of one rule's matches."""
    found = F.regexp_extract_all(norm, rule["re"], F.lit(0))
    rest = F.split(norm, rule["re"], -1)

    def one(m: Column, i: Column) -> Column:
        start = _total(F.slice(rest, F.lit(1), i + 1)) + _total(F.slice(found, F.lit(1), i))
        # sorted as a struct: by start, longest first, then priority
        return F.struct(
            start.alias("start"), (-(start + _blanks(m) + 1)).alias("neg_stop"), rule["prio"].alias("prio"),
            rule["label"].alias("label"), rule["w"].alias("w"),
        )

    return F.transform(found, one)


def _kept(norm: Column, table: Column) -> Column:
    """(labels, score) of the detections that lie in no other one."""
    hits = F.filter(table, lambda r: F.contains(norm, r["kw"]) & F.regexp_like(norm, r["re"]))
    dets = F.sort_array(F.flatten(F.transform(hits, lambda r: _places(norm, r))))
    zero = F.struct(F.lit(0).alias("stop"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))

    def step(acc: Column, d: Column) -> Column:
        # sorted by start, so it is contained iff an earlier one ends no sooner
        new = -d["neg_stop"] > acc["stop"]
        return F.struct(
            F.greatest(acc["stop"], -d["neg_stop"]).alias("stop"),
            F.when(new, F.array_union(acc["labels"], F.array(d["label"]))).otherwise(acc["labels"]).alias("labels"),
            F.when(new, F.greatest(acc["score"], d["w"])).otherwise(acc["score"]).alias("score"),
        )

    return F.aggregate(dets, zero, step)


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", table: list[dict] | None = None) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score.

    Null texts count as empty: no words, no places, empty labels, score 0.
    Repeated rows each get a row.  Only the id and text columns are read.
    ``score`` is the largest weight of a kept detection or 0.8 for a base phrase.
    """
    rows = table if table is not None else rules()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    df = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    df = df.select("doc_id", single_blanks(F.translate(F.col("text"), upper, lower), NOT_ALNUM).alias("norm"))
    # keyword prefilter: one word of each keyword and base phrase, the longest
    gate = F.concat(F.lit(" "), "norm", F.lit(" ")).contains(" cc ")
    for kw in sorted({max(kw.split(), key=len) for kw in [*(r["kw"] for r in rows), *(p for p, _ in BASE)]} - {"cc"}):
        gate = gate | F.contains("norm", F.lit(kw))
    df = df.select("doc_id", count_words(F.col("norm")).alias("n_words"), F.when(gate, F.col("norm")).alias("norm"))

    # each word between blanks of its own, so that neighbours share none
    pad = F.concat(F.lit(" "), F.replace("norm", F.lit(" "), F.lit("  ")), F.lit(" "))
    df = df.withColumn("pad", pad)
    n, first, last, labels = [], [], [], []
    for phrase, label in BASE:
        words = phrase.count(" ") + 1
        mark = f" {phrase.replace(' ', '  ')} "
        count = ((F.length("pad") - F.length(F.replace("pad", F.lit(mark), F.lit("")))) / len(mark)).cast("long")
        has = F.coalesce(F.contains("pad", F.lit(mark)), F.lit(False))
        head = F.substring_index("pad", mark, 1)
        tail = F.substring_index("pad", mark, -1)
        n.append(F.when(has, count).otherwise(F.lit(0)))
        first.append(F.when(has, (_blanks(head) / 2).cast("long")))
        last.append(F.when(has, F.col("n_words") - (_blanks(tail) / 2).cast("long") - words))
        labels.append(F.when(has, F.lit(label)))
    schema = "array<struct<prio:int,label:string,kw:string,re:string,w:double>>"
    df = df.select(
        "doc_id", "n_words", "norm",
        (n[0] + n[1] + n[2]).cast("long").alias("n_base"),
        F.least(*first).alias("first_word"),
        F.greatest(*last).alias("last_word"),
        F.array_compact(F.array(*labels)).alias("base"),
    )
    table_col = F.from_json(F.lit(json.dumps(rows)), schema)
    # one evaluation per text: the pair is exploded from a one-element array
    df = df.withColumn("kept", F.when(F.col("norm").isNotNull(), _kept(F.col("norm"), table_col)))
    found = F.coalesce("kept.labels", F.array().cast("array<string>"))
    return df.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", found)), ",").alias("labels"),
        F.greatest(F.coalesce("kept.score", F.lit(0.0)), F.when(F.size("base") > 0, 0.8).otherwise(0.0)).alias("score"),
    )
