"""License recognition by sentences and rules.

A text is cut into sentences, each sentence is normalised and mapped to the identifier of a known
licence sentence, and the document's sequence of identifiers is matched against ordered rules. A rule
that matches takes its identifiers out of the sequence, so later, more general rules see what is left.

A sentence may be wrapped over lines, or lines without an end mark (titles, code) may stand around it. So
within each piece of text between two end marks or empty lines, a known sentence is any run of lines that
reads like it; a run within a longer one doesn't count.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of licence texts, normalised (lower case, other characters than letters,
#: digits as one blank), with their identifiers.
TEXTS = {
    "licensed under the apache license version 2 0 the license": "ApacheHead2",
    "you may not use this file except in compliance with the license": "ApacheUse",
    "you may obtain a copy of the license at": "ApacheCopy",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "ApacheCopy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "ApacheAsIs",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheSee",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MITGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MITNotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MITAsIs",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "MITLiable",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPLHead3Plus",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "GPLHead2Plus",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GPLHope",
    "see the gnu general public license for more details": "GPLSee",
    "you should have received a copy of the gnu general public license along with this program": "GPLCopy",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSDGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSDSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSDBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSDEndorse",
    "this source code form is subject to the terms of the mozilla public license v": "MPLHead2",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISCGrant",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "BSDAsIs",
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services": "BSDLiable",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "GPLTerms",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPLHead3Plus",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "LGPLTerms",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "LGPLHead3Plus",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation": "AGPLTerms",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "AGPLHead3Plus",
    "either version 2 of the license or at your option any later version": "Later2",
    "either version 2 1 of the license or at your option any later version": "Later21",
    "either version 3 of the license or at your option any later version": "Later3",
    "version 2 of the license": "Only2",
    "version 2 1 of the license": "Only21",
    "version 3 of the license": "Only3",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISCGrant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0BSDGrant",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "ZlibGrant",
    "this software is provided as is without any express or implied warranty": "ZlibAsIs",
    "this is free and unencumbered software released into the public domain": "UnlicenseGrant",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "BSLGrant",
    "the accompanying program is provided under the terms of this eclipse public license agreement": "EPLGrant",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at": "EPL2Head",
    "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law including all related and neighboring rights to the extent allowed by law": "CC0Deed",
    "you just do what the fuck you want to": "WTFPLGrant",
    "0 you just do what the fuck you want to": "WTFPLGrant",
    "all rights reserved": "AllRights",
}

#: Rules of several sentences or of one, in order, most specific first; each is a licence and a
#: run of identifiers.
TEXT_RULES = [
    ("Apache-2.0", ["ApacheHead2", "ApacheUse", "ApacheCopy", "ApacheAsIs", "ApacheSee"]),
    ("Apache-2.0", ["ApacheHead2", "ApacheUse", "ApacheCopy"]),
    ("MIT", ["MITGrant", "MITNotice", "MITAsIs", "MITLiable"]),
    ("MIT", ["MITGrant", "MITNotice"]),
    ("GPL-3.0-or-later", ["GPLHead3Plus", "GPLHope", "GPLSee", "GPLCopy"]),
    ("GPL-2.0-or-later", ["GPLHead2Plus", "GPLHope", "GPLSee", "GPLCopy"]),
    ("BSD-3-Clause", ["BSDGrant", "BSDSource", "BSDBinary", "BSDEndorse"]),
    ("BSD-2-Clause", ["BSDGrant", "BSDSource", "BSDBinary"]),
    ("ISC", ["ISCGrant"]),
    ("GPL-3.0-or-later", ["GPLHead3Plus"]),
    ("GPL-2.0-or-later", ["GPLHead2Plus"]),
    ("MPL-2.0", ["MPLHead2"]),
    ("LGPL-3.0-or-later", ["LGPLHead3Plus"]),
    ("AGPL-3.0-or-later", ["AGPLHead3Plus"]),
    ("GPL-2.0-or-later", ["GPLTerms", "Later2"]),
    ("GPL-3.0-or-later", ["GPLTerms", "Later3"]),
    ("GPL-2.0-only", ["GPLTerms", "Only2"]),
    ("GPL-3.0-only", ["GPLTerms", "Only3"]),
    ("LGPL-2.1-or-later", ["LGPLTerms", "Later21"]),
    ("LGPL-3.0-or-later", ["LGPLTerms", "Later3"]),
    ("LGPL-2.1-only", ["LGPLTerms", "Only21"]),
    ("LGPL-3.0-only", ["LGPLTerms", "Only3"]),
    ("AGPL-3.0-or-later", ["AGPLTerms", "Later3"]),
    ("AGPL-3.0-only", ["AGPLTerms", "Only3"]),
    ("Zlib", ["ZlibAsIs", "ZlibGrant"]),
    ("Zlib", ["ZlibGrant"]),
    ("0BSD", ["0BSDGrant"]),
    ("Unlicense", ["UnlicenseGrant"]),
    ("BSL-1.0", ["BSLGrant"]),
    ("EPL-1.0", ["EPL10Ref", "EPLGrant"]),
    ("EPL-2.0", ["EPL20Ref", "EPLGrant"]),
    ("EPL-2.0", ["EPL2Head"]),
    ("CC0-1.0", ["CC0Deed"]),
    ("WTFPL", ["WTFPLGrant"]),
    ("BSD-3-Clause", ["BSDEndorse", "BSDAsIs", "BSDLiable"]),
]
#: These hold only where no other licence was found.
LAST_RULES = [("Proprietary", ["AllRights"])]

#: How licences are called, as SPDX identifier and names (normalised).
NAMES = {
    "MIT": ["the mit license", "the mit licence", "the expat license", "mit"],
    "Apache-2.0": ["the apache license version 2 0", "the apache license 2 0", "apache license 2 0", "apache 2 0"],
    "BSD-2-Clause": ["the bsd 2 clause license", "the simplified bsd license", "bsd 2 clause"],
    "BSD-3-Clause": ["the bsd 3 clause license", "the new bsd license", "the modified bsd license", "bsd 3 clause"],
    "MPL-2.0": ["the mozilla public license version 2 0", "the mozilla public license 2 0", "mpl 2 0"],
    "EPL-2.0": ["the eclipse public license version 2 0", "the eclipse public license 2 0", "epl 2 0"],
    "BSL-1.0": ["the boost software license version 1 0", "the boost software license 1 0"],
    "ISC": ["the isc license"],
    "Zlib": ["the zlib license"],
    "Unlicense": ["the unlicense"],
    "CC0-1.0": ["cc0 1 0", "cc0", "the creative commons zero v1 0 universal license"],
    "0BSD": ["the zero clause bsd license", "the bsd zero clause license"],
    "MIT-0": ["the mit no attribution license"],
    "Apache-1.1": ["the apache license version 1 1"],
    "MPL-1.1": ["the mozilla public license version 1 1"],
    "EPL-1.0": ["the eclipse public license version 1 0", "epl 1 0"],
    "CDDL-1.0": ["the common development and distribution license version 1 0"],
    "EUPL-1.2": ["the european union public licence version 1 2"],
    "Artistic-2.0": ["the artistic license 2 0"],
    "OFL-1.1": ["the sil open font license version 1 1"],
    "MS-PL": ["the microsoft public license"],
    "NCSA": ["the university of illinois ncsa open source license"],
    "PostgreSQL": ["the postgresql license"],
    "WTFPL": ["the wtfpl"],
}

#: Lines by which a licence text begins.
TITLES = {
    "MIT": ["mit license", "mit licence", "the mit license", "the mit license mit", "the mit licence", "license mit"],
    "Apache-2.0": ["apache license version 2 0 january 2004", "apache license version 2 0", "license apache 2 0"],
    "BSD-2-Clause": ["bsd 2 clause license", "the 2 clause bsd license", "license bsd 2 clause"],
    "BSD-3-Clause": ["bsd 3 clause license", "the 3 clause bsd license", "license bsd 3 clause"],
    "ISC": ["isc license", "the isc license", "isc license isc", "license isc"],
    "MPL-2.0": ["mozilla public license version 2 0", "license mpl 2 0"],
    "BSL-1.0": ["boost software license version 1 0 august 17th 2003", "boost software license version 1 0"],
    "EPL-2.0": ["eclipse public license v 2 0"],
    "EPL-1.0": ["eclipse public license v 1 0"],
    "CC0-1.0": ["creative commons legal code cc0 1 0 universal", "cc0 1 0 universal", "creative commons cc0 1 0 universal"],
    "Zlib": ["zlib license", "the zlib license"],
    "Artistic-2.0": ["the artistic license 2 0"],
    "OFL-1.1": ["sil open font license version 1 1 26 february 2007"],
    "GPL-2.0-only": ["gnu general public license version 2 june 1991"],
    "GPL-3.0-only": ["gnu general public license version 3 29 june 2007"],
    "LGPL-2.1-only": ["gnu lesser general public license version 2 1 february 1999"],
    "LGPL-3.0-only": ["gnu lesser general public license version 3 29 june 2007"],
    "AGPL-3.0-only": ["gnu affero general public license version 3 19 november 2007"],
}

#: The families whose names follow one pattern.
GNU = {"GPL": ("gnu general public license", ["2.0", "3.0"]), "LGPL": ("gnu lesser general public license", ["2.1", "3.0"]), "AGPL": ("gnu affero general public license", ["3.0"])}
LATER = ["or later", "or any later version", "or at your option any later version"]
CREATIVE = {"BY": "attribution", "BY-SA": "attribution sharealike", "BY-NC": "attribution noncommercial", "BY-ND": "attribution noderivatives", "BY-NC-SA": "attribution noncommercial sharealike", "BY-NC-ND": "attribution noncommercial noderivatives"}

#: How a text says what it is licensed under.
SUBJECTS = ["", "this file is ", "this software is ", "this program is ", "this project is ", "this work is ", "this code is "]
VERBS = ["licensed under", "released under", "distributed under", "available under"]
BOTH = ["licensed under", "dual licensed under", "licensed under either", "licensed under either of"]


def normal(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


def licence_names() -> dict[str, list[str]]:
    """The names of each licence, families included."""
    found = {licence: list(names) for licence, names in NAMES.items()}
    for short, (long, versions) in GNU.items():
        for version in versions:
            number = normal(version.removesuffix(".0"))
            names = [f"the {long} version {number}", f"the {long} v{number}", f"the gnu {short.lower()} version {number}", f"the gnu {short.lower()} v{number}", f"the {short.lower()} v{number}", f"{short.lower()} {normal(version)}"]
            found[f"{short}-{version}-only"] = names
            found[f"{short}-{version}-or-later"] = [f"{name} {later}" for name in names for later in LATER]
    for short, long in CREATIVE.items():
        for version in ("3.0", "4.0"):
            v, kind = normal(version), "unported" if version == "3.0" else "international"
            found[f"CC-{short}-{version}"] = [f"cc {normal(short)} {v}", f"the cc {normal(short)} {v} license", f"a creative commons {long} {v} {kind} license", f"the creative commons {long} {v} {kind} license"]
    return found


#: The beginning of a line of an SPDX identifier, and the identifier of sentences that name two licences to choose from.
SPDX_LINE = "spdx license identifier "
DUAL = "MITApacheRef"


def reference(licence: str) -> str:
    return licence.replace("-", "").replace(".", "") + "Ref"


def references() -> dict[str, str]:
    """Each sentence that only names a licence, with the identifier of that licence."""
    found = {}
    for licence, names in licence_names().items():
        own = reference(licence)
        for name in names:
            found |= {f"{subject}{verb} {name}": own for subject in SUBJECTS for verb in VERBS}
        found[f"{SPDX_LINE}{normal(licence)}"] = own
        if licence.endswith("-only"):  # the identifiers of before 2018
            found[f"{SPDX_LINE}{normal(licence.removesuffix('-only'))}"] = own
    for licence, titles in TITLES.items():
        found |= dict.fromkeys(titles, reference(licence))
    names = licence_names()
    for one in [*names["MIT"], "mit license"]:
        for other in [*names["Apache-2.0"], "apache license version 2 0"]:
            for pair in (f"{one} {{}} {other}", f"{other} {{}} {one}"):
                found |= {f"{subject}{verb} {pair.format(join)}": DUAL for subject in SUBJECTS for verb in BOTH for join in ("and", "or")}
    return found


#: Known sentences with their identifiers, and the rules in order.
SENTENCES = TEXTS | references()
RULES = [*TEXT_RULES, ("MIT OR Apache-2.0", [DUAL]), *((licence, [reference(licence)]) for licence in licence_names()), *LAST_RULES]

#: A piece of text ends at an end mark before white space (of ASCII), or at a line without letters and digits.
#: The colon of an SPDX line is none.
ENDS = r"[.!?:;][ \t\r\f\n]+|\n[^a-zA-Z0-9\n]*\n"
ASIDE = r"[(](see|full text in|cf) [^()]*[)]"
SPDX, SPDX_OPEN = r"(?i)(spdx-licen[cs]e-identifier):", "$1 "

#: A piece without any known sentence counts as licence talk if it has one of these words, each of which
#: begins with one of the stems.
LICENCE_WORDS = r"(^| )(licen[cs]ed?|licen[cs]es|copyright|redistribut(e|ion))( |$)"
STEMS = ["licen", "copyright", "redistribut"]

#: Sentences or rules of a table at most: they are part of the plan.
MOST = 100_000


@dataclass(frozen=True)
class Tables:
    """Known sentences (any text, to identifiers without commas and bars) and ordered rules."""

    sentences: dict[str, str] = field(default_factory=lambda: SENTENCES)
    rules: Iterable[tuple[str, list[str]]] = field(default_factory=lambda: RULES)
    last: frozenset[str] = frozenset(licence for licence, _ in LAST_RULES)

    @classmethod
    def of(cls, sentences: DataFrame, rules: DataFrame) -> Tables:
        """From tables (sentence, identifier) and (place, licence, identifiers). More than ``MOST`` rows: an error."""
        known, ordered = sentences.select("sentence", "identifier").limit(MOST + 1).collect(), rules.select("place", "licence", "identifiers").limit(MOST + 1).collect()
        if max(len(known), len(ordered)) > MOST:
            raise ValueError(f"a table of more than {MOST} sentences or rules")
        return cls({r[0]: r[1] for r in known}, [(r[1], list(r[2])) for r in sorted(ordered)])

    def normalised(self) -> dict[str, str]:
        return {n: i for s, i in self.sentences.items() if (n := normal(s))}

    def hints(self) -> list[str]:
        """Strings of which each known sentence and each licence word has one: ``STEMS``, and words chosen
        greedily among those of six letters or more (a sentence without such a word: its longest)."""
        left = [s for s in self.normalised() if not any(stem in s for stem in STEMS)]
        chosen = list(STEMS)
        while left:
            counts: dict[str, int] = {}
            for s in left:
                words = s.split()
                for word in {w for w in words if len(w) >= 6} or {max(words, key=len)}:
                    counts[word] = counts.get(word, 0) + 1
            best = max(counts, key=lambda w: (counts[w], w))
            chosen.append(best)
            left = [s for s in left if best not in s]
        return chosen


class Lookup:
    """A dictionary as one literal of the plan, found by hash: its size doesn't matter to a search."""

    def __init__(self, values: dict[str, str]):
        self.slots = max(1, len(values))
        held: list[dict[str, str]] = [{} for _ in range(self.slots)]
        for key, value in values.items():
            held[zlib.crc32(key.encode()) % self.slots][key] = value
        self.literal = F.from_json(F.lit(json.dumps(held)), "array<map<string,string>>")

    def __call__(self, key: Column) -> Column:
        return F.element_at(F.element_at(self.literal, (F.crc32(key) % self.slots + 1).cast("int")), key)


def normalise(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def sequence_text(ids: list[str]) -> str:
    return "," + ",,".join(ids) + ","


def beginnings(sentences: Iterable[str]) -> dict[str, str]:
    """The first word, and the first two, of each sentence."""
    return {" ".join(s.split()[:n]): "" for s in sentences for n in (1, 2)}


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tables: Tables | None = None) -> DataFrame:
    """``id_col``, sentence_ids (known identifiers in text order), licenses (distinct, in the order of
    the rules), unmatched (identifiers that no rule took) and unknown_sentences (pieces of licence talk
    without any known sentence) for each document.

    The tables are literals of the plan: one scan, no shuffle, no Python. Null and empty text: no
    identifiers, no licences. Licences of ``tables.last`` are left out beside others. An SPDX line counts as one
    line for each identifier of its expression (OR, AND, brackets; ``+`` is or-later; what follows WITH is no licence);
    "(see LICENSE)" and the like are skipped. A text of any length is one array of its pieces that have a hint. Null and
    repeated ids are carried along; no rows: none out. Other columns are not read.
    """
    tables = tables or Tables()
    sentences, hints = tables.normalised(), tables.hints()
    known, begins = Lookup(sentences), Lookup(beginnings(sentences))
    most_words = max((len(s.split()) for s in sentences), default=1)

    # Only texts and pieces with a hint are worked on further: the test is cheap, the rest is not.
    def hinted(text: Column) -> Column:
        found = F.lit(False)
        for hint in hints:
            found = found | F.contains(text, F.lit(hint))
        return found

    def lines(piece: Column) -> Column:
        return F.filter(F.flatten(F.transform(F.split(piece, "\n"), own_lines)), lambda line: line != "")

    def own_lines(line: Column) -> Column:
        spdx = normalise(F.regexp_replace(line, r"([0-9])\+", "$1 or later"))
        return F.when(F.contains(line, F.lit("spdx")) & F.contains(spdx, F.lit(SPDX_LINE)), members(spdx)).otherwise(F.array(normalise(F.regexp_replace(line, ASIDE, " "))))

    def members(line: Column) -> Column:
        """An SPDX line for each identifier of its expression."""
        kept = F.replace(line, F.lit(" or later"), F.lit(" orlater"))
        for word in (" or ", " and "):
            kept = F.replace(kept, F.lit(word), F.lit("|" + SPDX_LINE))
        return F.transform(F.split(kept, r"\|"), lambda one: F.regexp_replace(F.replace(one, F.lit(" orlater"), F.lit(" or later")), " with .*$", ""))

    def runs(own: Column) -> Column:
        """(first line, last line) of the longest run of each line that reads like a known sentence."""

        def longest(first: Column) -> Column:
            # A run has a word in each line, so that it isn't longer than the longest sentence has words.
            last = F.filter(F.sequence(first, F.least(F.size(own) - 1, first + (most_words - 1))), lambda j: known(F.array_join(F.slice(own, first + 1, j - first + 1), " ")).isNotNull())
            return F.struct(first.alias("first"), F.array_max(last).alias("last"))

        firsts = F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: begins(F.substring_index(F.get(own, i), " ", 2)).isNotNull())
        return F.filter(F.transform(firsts, longest), lambda run: run["last"].isNotNull())

    def outermost(own: Column, found: Column) -> Column:
        """The identifiers of the runs that don't lie within an earlier one."""

        def step(state: Column, run: Column) -> Column:
            identifier = known(F.array_join(F.slice(own, run["first"] + 1, run["last"] - run["first"] + 1), " "))
            longer = F.struct(run["last"].alias("top"), F.concat(state["ids"], F.array(identifier)).alias("ids"))
            return F.when(run["last"] > state["top"], longer).otherwise(state)

        return F.aggregate(found, F.struct(F.lit(-1).alias("top"), F.array().cast("array<string>").alias("ids")), step, lambda state: state["ids"])

    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    text = F.when(hinted(text), F.regexp_replace(text, SPDX, SPDX_OPEN)).otherwise(F.lit(""))
    pieces = F.filter(F.transform(F.filter(F.split(text, ENDS), hinted), lines), lambda own: F.size(own) > 0)
    docs = docs.select(F.col(id_col), pieces.alias("_pieces"))
    docs = docs.select(id_col, F.transform("_pieces", lambda own: F.struct(own.alias("own"), runs(own).alias("found"))).alias("_pieces"))
    docs = docs.select(
        id_col,
        F.flatten(F.transform("_pieces", lambda p: outermost(p["own"], p["found"]))).alias("sentence_ids"),
        F.size(F.filter("_pieces", lambda p: (F.size(p["found"]) == 0) & F.array_join(p["own"], " ").rlike(LICENCE_WORDS))).cast("long").alias("unknown_sentences"),
    )
    ordered = F.from_json(F.lit(json.dumps([{"licence": licence, "run": sequence_text(ids)} for licence, ids in tables.rules if ids])), "array<struct<licence:string,run:string>>")

    def apply(state: Column, rule: Column) -> Column:
        taken = F.struct(F.replace(state["left"], rule["run"], F.lit("|")).alias("left"), F.concat(state["found"], F.array(rule["licence"])).alias("found"))
        return F.when(F.contains(state["left"], rule["run"]), taken).otherwise(state)

    start = F.struct(F.concat_ws("", F.transform("sentence_ids", lambda i: F.concat(F.lit(","), i, F.lit(",")))).alias("left"), F.array().cast("array<string>").alias("found"))
    docs = docs.withColumn("_end", F.when(F.size("sentence_ids") > 0, F.aggregate(ordered, start, apply)).otherwise(start))
    rest = F.filter(F.split(F.translate("_end.left", "|", ","), ","), lambda i: i != "")
    own = F.filter("_end.found", lambda licence: ~licence.isin(sorted(tables.last)) if tables.last else F.lit(True))
    licenses = F.array_distinct(F.when(F.size(own) > 0, own).otherwise(F.col("_end.found")))
    return docs.select(id_col, "sentence_ids", licenses.alias("licenses"), rest.alias("unmatched"), "unknown_sentences")
