r"""License scans by ordered signature rules, in DataFrame functions only.

Texts are lower-cased (A-Z) and turned into words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` with one space around each. A rule is a regular expression over that form, with a keyword that its matches contain, a priority (smaller is
stronger), a label and a weight. Few texts pass the first gate, a handful of substrings one of which every rule needs; for them only rules whose own keyword occurs are run. The
distinct matches' word intervals are then resolved: an interval within another one is dropped (of equal intervals the one of the stronger rule stays); then, from the strongest priority to the weakest, what overlaps an interval of a
stronger priority that has been kept is dropped, so that chains of overlaps end in the same result whatever their length. Long texts with many matches are handled as rows, sorted by a window, not as arrays.

Null texts are empty. Rows of docs are kept apart by a row number, so that repeated rows and ids give a row each.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm._shared import row_at, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MARK = "\u0001"  # no word holds it

#: Fixed by the contract: phrases whose every place counts, with their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Substrings one of which is in every text that a rule can match: within one word each, since any white space or punctuation may stand between words. The first is a regular expression over the text as it is, for words that common ones contain.
_GATE_PATTERN = r"(?i)cc[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+by"
_GATES = ("licen", "spdx", "copyright", "reserved", "domain", "redistribution", "permission", "warrant", "reproduced", "prohibited", "proprietary", "misrepresent", "endorse", "acknowledgement", "exception", "osl", "mulan")
#: Pairs of words one of which is in all other texts that a rule can match. The second word is looked for first.
_GATE_PAIRS = (("general", "public"), ("not", "evil"), ("as", "perl"), ("no", "attribution"), ("source", "agreement"))

#: What stands before "under" in a grant. Grants need not hold one of _GATES, and pass by these two words in a row.
_GRANTS = "(?:licensed|released|distributed|published|available|provided)"

#: label, keyword, name as a regular expression over words, versions as such
_NAMES = (
    ("apache", "apache", r"apache(?: software)?", ("2 0", "1 1", "1 0")),
    ("mit", "mit", r"mit", ()),
    ("mit", "expat", r"expat", ()),
    ("mit", "x11", r"x11", ()),
    ("bsd", "bsd", r"(?:new |simplified |modified |revised )?bsd(?: 0 clause| 1 clause| 2 clause| 3 clause| 4 clause)?", ("2", "3")),
    ("gpl", "gnu", r"gnu (?:general public|gpl)", ("3", "3 0", "2", "2 0", "1")),
    ("gpl", "gpl", r"(?:gpl|gplv[123])", ("3", "3 0", "2", "2 0")),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public", ("3", "2 1", "2")),
    ("lgpl", "lgpl", r"(?:lgpl|lgplv[23])", ("3", "2 1", "2")),
    ("agpl", "affero", r"(?:gnu )?affero general public", ("3", "1")),
    ("agpl", "agpl", r"(?:agpl|agplv3)", ("3",)),
    ("fdl", "documentation", r"(?:gnu )?free documentation", ("1 3", "1 2", "1 1")),
    ("mpl", "mozilla", r"mozilla public", ("2 0", "1 1", "1 0")),
    ("epl", "eclipse", r"eclipse public", ("2 0", "1 0")),
    ("cddl", "distribution", r"common development and distribution", ("1 1", "1 0")),
    ("cc-by", "by", r"(?:cc|creative commons) by", ("4 0", "3 0", "2 5", "2 0")),
    ("cc-by", "attribution", r"(?:cc|creative commons) attribution", ("4 0", "3 0", "2 5", "2 0")),
    ("cc-by-sa", "sa", r"(?:cc by sa|creative commons attribution sa)", ("4 0", "3 0", "2 5", "2 0")),
    ("cc-by-sa", "sharealike", r"creative commons attribution sharealike", ("4 0", "3 0")),
    ("cc-by-nd", "nd", r"cc by nd", ("4 0", "3 0")),
    ("cc-by-nd", "noderiv", r"creative commons attribution noderiv(?:s|atives)", ("4 0", "3 0")),
    ("cc-by-nc", "nc", r"cc by nc", ("4 0", "3 0", "2 0")),
    ("cc-by-nc", "noncommercial", r"creative commons attribution noncommercial", ("4 0", "3 0")),
    ("cc-by-nc-sa", "nc sa", r"cc by nc sa", ("4 0", "3 0")),
    ("cc-by-nc-nd", "nc nd", r"cc by nc nd", ("4 0", "3 0")),
    ("cc0", "cc0", r"cc0", ("1 0",)),
    ("cc", "commons", r"creative commons", ("4 0", "3 0", "2 0")),
    ("unlicense", "unlicense", r"(?:the )?unlicense", ()),
    ("isc", "isc", r"isc", ()),
    ("zlib", "zlib", r"(?:zlib|zlib libpng)", ()),
    ("boost", "boost", r"boost(?: software)?", ("1 0",)),
    ("artistic", "artistic", r"artistic", ("2 0", "1 0")),
    ("wtfpl", "wtfpl", r"wtfpl", ("2",)),
    ("python", "python", r"python(?: software foundation)?", ("2", "3")),
    ("ofl", "open font", r"(?:sil )?open font", ("1 1", "1 0")),
    ("odbl", "open database", r"open database", ("1 0",)),
    ("eupl", "european", r"european union public", ("1 2", "1 1")),
    ("postgresql", "postgresql", r"postgresql", ()),
    ("ms-pl", "microsoft", r"microsoft (?:public|reciprocal)", ()),
)

#: Signatures, each a sentence or phrase of a licence, a notice or a grant: priority, label, keyword, regular expression, weight. Keywords are words of all that the expression matches.
_SIGNATURES = (
    # texts of permissive licences
    (1, "mit", "hereby", r"permission is hereby granted free of charge(?: to any person obtaining a copy of this software)?", 0.9),
    (1, "mit", "permission", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 0.9),
    (2, "mit", "copyright", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability", 0.7),
    (1, "mit-0", "attribution", r"mit no attribution(?: license)?", 0.9),
    (1, "bsd", "redistribution", r"redistribution and use in source and binary forms(?: with or without modification)?", 0.9),
    (1, "bsd", "redistributions", r"redistributions of source code must retain the above copyright notice", 0.9),
    (1, "bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice", 0.9),
    (1, "bsd-3", "endorse", r"neither the name of (?:[a-z0-9]{1,20} ){1,8}nor the names of its contributors may be used to endorse or promote products", 0.9),
    (1, "bsd-4", "acknowledgement", r"all advertising materials mentioning features or use of this software must display the following acknowledgement", 0.9),
    (2, "bsd", "warranties", r"this software is provided by the (?:copyright holders|regents|authors?) and contributors as is and any express or implied warranties", 0.8),
    (1, "bsd-0", "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0.9),
    (1, "isc", "permission", r"permission to use copy modify and or distribute this software", 0.9),
    (2, "isc", "disclaims", r"the software is provided as is and the author disclaims all warranties with regard to this software", 0.8),
    (1, "apache-2", "compliance", r"you may not use this file except in compliance with the license", 0.9),
    (2, "apache-2", "obtain", r"you may obtain a copy of the license at", 0.7),
    (2, "apache-2", "writing", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 0.9),
    (2, "apache-2", "governing", r"see the license for the specific language governing permissions and limitations under the license", 0.9),
    (2, "apache-2", "contributor", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license", 0.9),
    (1, "apache-llvm", "llvm", r"apache license v?2 0 with llvm exceptions?", 1.0),
    (1, "zlib", "misrepresented", r"the origin of this software must not be misrepresented", 0.9),
    (2, "zlib", "altered", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 0.9),
    (2, "zlib", "warranty", r"this software is provided as is without any express or implied warranty", 0.6),
    (1, "boost", "organization", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", 1.0),
    (1, "unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 1.0),
    (1, "json", "evil", r"the software shall be used for good not evil", 0.9),
    (2, "beerware", "beer", r"(?:the )?beer ?ware license", 0.9),
    (2, "wtfpl", "want", r"do what the fuck you want to public license", 0.9),
    (2, "ncsa", "illinois", r"university of illinois(?: ncsa)? open source license", 0.9),
    (2, "upl", "permissive", r"universal permissive license", 0.9),
    (2, "blue-oak", "oak", r"blue oak model license", 0.9),
    (2, "afl", "academic", r"academic free license", 0.9),
    (2, "ecl", "educational", r"educational community license", 0.9),
    (2, "w3c", "w3c", r"w3c (?:software|document|software and document)(?: notice and)? license", 0.9),
    (2, "unicode", "unicode", r"unicode license(?: agreement)?", 0.8),
    (2, "openssl", "openssl", r"openssl license", 0.8),
    (2, "php", "php", r"php license", 0.8),
    (2, "ruby", "ruby", r"ruby(?: s)? license", 0.8),
    (2, "psf", "licensee", r"psf is making python(?: [0-9]{1,2}){0,3} available to licensee on an as is basis", 0.9),
    # texts of copyleft licences
    (1, "gpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public license", 1.0),
    (1, "lgpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", 1.0),
    (1, "agpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu affero general public license", 1.0),
    (1, "gpl", "received", r"you should have received a copy of the gnu general public license", 0.9),
    (1, "lgpl", "received", r"you should have received a copy of the gnu (?:lesser|library) general public license", 0.9),
    (1, "agpl", "received", r"you should have received a copy of the gnu affero general public license", 0.9),
    (2, "gpl-2", "option", r"either version 2 of the license or at your option any later version", 0.9),
    (2, "gpl-3", "option", r"either version 3 of the license or at your option any later version", 0.9),
    (2, "lgpl-2.1", "option", r"either version 2 1 of the license or at your option any later version", 0.9),
    (2, "gpl", "verbatim", r"everyone is permitted to copy and distribute verbatim copies of this license document", 0.9),
    (3, "gpl", "merchantability", r"without even the implied warranty of merchantability or fitness for a particular purpose", 0.6),
    (2, "gpl", "copyleft", r"copyleft license", 0.5),
    (1, "classpath-exception", "classpath", r"(?:gpl|license) with classpath exception", 0.9),
    (1, "gcc-exception", "gcc", r"gcc runtime library exception|gcc runtime library license exception", 0.9),
    (1, "mpl-2", "mozilla", r"this source code form is subject to the terms of the mozilla public license(?: v| version)? ?2 0", 1.0),
    (2, "mpl", "initial", r"the initial developer of the original code(?: is)?(?: [a-z]{1,20}){0,3} license", 0.7),
    (1, "epl", "accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public license", 1.0),
    (1, "cddl", "contents", r"the contents of this file are subject to the terms of the common development and distribution license", 1.0),
    (2, "osl", "osl", r"licensed under the osl|osl license", 0.7),
    (2, "osl", "software", r"open software license", 0.8),
    (2, "cecill", "cecill", r"cecill(?: b| c)? (?:license|licence)", 0.9),
    (2, "mulan", "mulan", r"mulan (?:psl|permissive software license)(?: v2)?", 0.9),
    (2, "sleepycat", "sleepycat", r"sleepycat license", 0.9),
    (2, "vim", "vim", r"vim license", 0.8),
    (2, "nasa", "nasa", r"nasa open source agreement(?: license)?", 0.8),
    (2, "rpl", "reciprocal", r"reciprocal public license", 0.8),
    (2, "artistic", "perl", r"under the same terms as perl itself", 0.8),
    # creative commons and data
    (1, "cc", "commons", r"this work is licensed under (?:a|the) creative commons(?: license)?", 1.0),
    (2, "cc", "credit", r"you must give appropriate credit provide a link to the license and indicate if changes were made", 0.9),
    (2, "cc-by-sa", "remix", r"if you remix transform or build upon the material you must distribute your contributions under the same license", 0.9),
    (2, "cc", "technological", r"you may not apply legal terms or technological measures that legally restrict others from doing anything the license permits", 0.9),
    (2, "cc0", "waived", r"has waived all copyright and related or neighbou?ring rights", 1.0),
    (1, "cc0", "universal", r"cc0 1 0 universal(?: public domain dedication| license)", 1.0),
    (2, "cc", "some", r"some rights reserved", 0.6),
    (3, "cc", "view", r"to view a copy of this license visit", 0.5),
    (2, "pddl", "dedication", r"(?:open data commons )?public domain dedication and licen[sc]e", 0.9),
    (2, "odc-by", "attribution", r"open data commons attribution licen[sc]e", 0.9),
    (2, "dbcl", "contents", r"database contents licen[sc]e", 0.9),
    (2, "ogl", "government", r"open government licen[sc]e", 0.9),
    (2, "etalab", "ouverte", r"(?:etalab )?licence ouverte", 0.9),
    (2, "cdla", "community", r"community data license agreement", 0.9),
    (2, "openrail", "responsible", r"responsible ai license", 0.8),
    (2, "fal", "art", r"free art licen[sc]e", 0.9),
    (2, "ofl", "font", r"with reserved font names?", 0.9),
    # public domain
    (2, "public-domain", "domain", r"(?:dedicated to|released into|placed in|in) the public domain", 0.8),
    (2, "public-domain", "known", r"(?:this work is free of|no) known copyright restrictions", 0.8),
    (2, "public-domain", "expired", r"copyright (?:has|have) expired", 0.7),
    (2, "public-domain", "no", r"no (?:copyright|rights reserved)", 0.6),
    (2, "public-domain", "government", r"works? of the (?:united states|u s|us) government (?:is|are) not (?:subject to|protected by) copyright", 0.8),
    # restricted
    (2, "business-source", "source", r"business source license", 0.8),
    (2, "sspl", "side", r"server side public license", 0.8),
    (2, "elastic", "elastic", r"elastic license", 0.8),
    (2, "commons-clause", "clause", r"commons clause license(?: condition)?", 0.8),
    (2, "polyform", "polyform", r"polyform (?:noncommercial|small business|shield|strict|perimeter) license", 0.8),
    (2, "hippocratic", "hippocratic", r"hippocratic license", 0.8),
    (2, "proprietary", "permission", r"without (?:the )?(?:express |specific )?(?:prior )?written permission", 0.7),
    (2, "proprietary", "reproduced", r"no part of this (?:publication|book|document|work|site|report) may be reproduced", 0.8),
    (2, "proprietary", "reproduced", r"may not be reproduced (?:distributed |copied )?(?:in any form|in whole or in part|without permission)", 0.8),
    (2, "proprietary", "prohibited", r"unauthori[sz]ed (?:copying|reproduction|duplication|distribution|use)(?: of this [a-z]{1,12})? is (?:strictly )?prohibited", 0.8),
    (2, "proprietary", "prohibited", r"(?:copying|reproduction|redistribution)(?: [a-z]{1,12}){0,4} (?:is|are) (?:strictly )?prohibited", 0.7),
    (2, "proprietary", "confidential", r"confidential and proprietary(?: information)?|proprietary and confidential(?: information)?", 0.7),
    (2, "proprietary", "license", r"end user license agreement", 0.7),
    (2, "proprietary", "proprietary", r"proprietary (?:license|software|licence)", 0.7),
    (2, "proprietary", "subject", r"subject to (?:the )?terms of (?:a|the|your) license agreement", 0.6),
    (2, "proprietary", "copyrighted", r"this (?:material|work|content|article) is copyrighted", 0.7),
    (2, "proprietary", "protected", r"protected by (?:international )?copyright laws?", 0.6),
    (2, "permission", "permission", r"(?:used|reprinted|reproduced) (?:with|by) (?:kind )?permission(?: of| from)?", 0.6),
    (2, "permission", "permission", r"all (?:images|text|content|photos) used (?:with|by) permission", 0.6),
    (2, "non-commercial", "only", r"licensed for (?:non commercial|noncommercial|personal|educational|academic) use only", 0.7),
    # notices
    (5, "copyright", "copyright", r"copyright(?: c)? (?:19|20)[0-9][0-9]", 0.4),
    (5, "copyright", "holder", r"copyright holders?", 0.3),
    (5, "copyright", "owner", r"copyright owners?", 0.3),
    (5, "disclaimer", "warrant", r"without (?:any )?warrant(?:y|ies)(?: of any kind)?(?: express or implied)?", 0.3),
    (5, "disclaimer", "warrant", r"no warrant(?:y|ies)(?: express or implied)?", 0.3),
    (6, "license-note", "licens", r"(?:see|read) (?:the )?(?:accompanying )?license(?: file)?", 0.2),
    (6, "license-note", "licens", r"under (?:the )?same license", 0.2),
    (6, "license-note", "licens", r"license agreement", 0.2),
    (6, "license-note", "licens", r"(?:dual|multi|triple) licensed", 0.3),
    (6, "license-note", "licens", r"third party licenses?", 0.2),
)


def rules() -> list[dict]:
    """All rules, in their order. Each name gives one for an identifier, one for a grant, one for its license, and the last two for each version."""
    out = [{"base": True, "priority": 0, "label": label, "keyword": f" {phrase} ", "pattern": f" {phrase}(?= )", "weight": 0.5} for phrase, label in BASE]

    def add(priority, label, keyword, pattern, weight):
        out.append({"base": False, "priority": priority, "label": label, "keyword": keyword, "pattern": f" {pattern}(?= )", "weight": weight})

    for label, keyword, name, versions in _NAMES:
        grant = rf"{_GRANTS} under (?:the )?(?:terms of (?:the )?)?{name}"
        for v in versions:
            short = v.removesuffix(" 0")
            add(0, f"{label}-{short.replace(' ', '.')}", keyword, rf"spdx license identifier {name} v?{v}(?: only| or later)?", 1.0)
            add(1, f"{label}-{short.replace(' ', '.')}", keyword, rf"{grant}(?: licen[sc]e)?(?: version| v)? ?v?{v}(?: or later)?", 1.0)
            add(2, f"{label}-{short.replace(' ', '.')}", keyword, rf"{name} licen[sc]e(?: version| v)? ?v?{v}(?: or later)?", 0.9)
        add(0, label, keyword, rf"spdx license identifier {name}", 1.0)
        add(3, label, keyword, rf"{grant}(?: licen[sc]e)?", 0.9)
        add(4, label, keyword, rf"{name} licen[sc]e", 0.7)
    for rule in _SIGNATURES:
        add(*rule)
    return out


def _words(text):
    """The words of a text with one space around each; null for a text that can't match any rule."""
    low = F.lower(text)
    gate = text.rlike(_GATE_PATTERN)
    for part in _GATES:
        gate = gate | low.contains(part)
    for first, second in _GATE_PAIRS:
        gate = gate | (low.contains(second) & low.rlike(rf"{first}[\x00-\x2F\x3A-\x60\x7B-\x7F]+{second}"))
    gate = gate | (low.contains("under") & low.rlike(rf"{_GRANTS}[\x00-\x2F\x3A-\x60\x7B-\x7F]+under"))
    return F.when(gate, F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" ")))


def _spaces(c):
    return (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))).cast("bigint")


def _pieces(docs: DataFrame, text: str) -> DataFrame:
    """All rows of docs but the text, numbered; for each rule that is run a row for each piece (i) of the text cut before its matches, with the words in it (own) and those of the match that it begins with (width).

    Rows that no rule is run on stay as one row without a rule. Texts and pieces go no further than this.
    """
    given = [{"rule": i, **r} for i, r in enumerate(rules())]
    table = F.from_json(F.lit(json.dumps(given)), "array<struct<rule:int,base:boolean,priority:int,label:string,keyword:string,pattern:string,weight:double>>")
    own = [F.col(f"`{c}`") for c in docs.columns if c != text]
    doc = F.struct(*own) if own else F.lit(None).cast("int")  # one column, so that no name of docs can clash
    rows = row_at(docs.select(doc.alias("__doc"), _words(F.coalesce(F.col(text), F.lit(""))).alias("__words")), "__row")
    others = ["__doc", "__row"]
    hits = rows.select(*others, "__words", F.explode_outer(F.filter(F.when(F.col("__words").isNotNull(), table), lambda r: F.expr("__words").contains(r["keyword"]))).alias("__rule"))
    pieces = hits.select(*others, "__rule", F.posexplode_outer(F.split(F.expr(f"regexp_replace(__words, __rule.pattern, '{_MARK}$0')"), _MARK)).alias("__i", "__piece"))
    width = _spaces(F.expr("regexp_extract(concat(__piece, ' '), concat('^', __rule.pattern), 0)"))
    pieces = pieces.select(*others, *(F.col(f"__rule.{c}").alias(f"__{c}") for c in ("rule", "base", "priority", "label", "weight")), "__i", _spaces(F.col("__piece")).alias("__own"), F.when(F.col("__i") > 0, width).alias("__width"))
    return written(pieces, "license-pieces")


def _detections(pieces: DataFrame) -> DataFrame:
    """__row, base, priority, label, weight, first, last (words from 0, last included), kept: every match of every rule."""
    pieces = pieces.where("__rule is not null").select("__row", *(F.col(f"__{c}").alias(c) for c in ("rule", "base", "priority", "label", "weight", "i", "own", "width")))
    before = Window.partitionBy("__row", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    found = pieces.withColumn("first", F.sum("own").over(before)).where("i > 0")
    found = found.withColumn("last", F.col("first") + F.col("width") - 1)
    order = Window.partitionBy("__row", "base").orderBy("first", F.desc("last"), "priority", "rule")
    found = found.withColumn("reach", F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    found = found.withColumn("out", F.col("base") | F.coalesce(F.col("reach") >= F.col("last"), F.lit(False)))
    # in what isn't out both starts and ends ascend
    forth, back = (Window.partitionBy("__row", "out").orderBy(order).rowsBetween(Window.unboundedPreceding, -1) for order in ("first", F.desc("first")))
    found = found.withColumn("beaten", F.lit(False))
    levels = sorted({r["priority"] for r in rules() if not r["base"]})
    for level in levels[1:]:
        stronger = (F.col("priority") < level) & ~F.col("beaten")
        found = found.withColumn("left", F.max(F.when(stronger, F.col("last"))).over(forth)).withColumn("right", F.min(F.when(stronger, F.col("first"))).over(back))
        meets = F.coalesce(F.col("left") >= F.col("first"), F.lit(False)) | F.coalesce(F.col("right") <= F.col("last"), F.lit(False))
        found = found.withColumn("beaten", F.col("beaten") | ((F.col("priority") == level) & meets))
    return found.select("__row", "base", "priority", "label", "weight", F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last"), (F.col("base") | (~F.col("out") & ~F.col("beaten"))).alias("kept"))


def _rows(pieces: DataFrame) -> DataFrame:
    """Each row of docs once, as __row and __doc."""
    return pieces.where("__rule is null").select("__row", "__doc").unionByName(pieces.where("__rule is not null").select("__row", "__doc").dropDuplicates(["__row"]))


def detections(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of docs but the text, with label, priority, weight, first_word and last_word: a row for each detection that stands after suppression, base phrases aside.

    Columns of docs with one of these names are replaced. Documents without a detection give no row.
    """
    pieces = _pieces(docs, text)
    added = [F.col(a).alias(b) for a, b in (("label", "label"), ("priority", "priority"), ("weight", "weight"), ("first", "first_word"), ("last", "last_word"))]
    others = [F.col(f"__doc.`{c}`").alias(c) for c in docs.columns if c not in (text, "label", "priority", "weight", "first_word", "last_word")]
    return _rows(pieces).join(_detections(pieces).where("kept and not base"), "__row").select(*others, *added)


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_base, first_word, last_word, base_labels, labels, score (the largest weight of what was found; 0 without)."""
    pieces = _pieces(docs.select("doc_id", "text"), "text")
    found = _detections(pieces).where("kept").groupBy("__row").agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("first"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("weight").alias("score"),
    )
    out = _rows(pieces).join(found, "__row", "left")
    return out.select(
        F.col("__doc.doc_id").alias("doc_id"),
        F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
