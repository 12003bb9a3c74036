"""License scans by ordered signature rules (operator 6).

Rules are hand-written signatures of three kinds: sentences of license bodies and
notices (``BODIES``), and, for every license family, what names it (a name, its
identifiers, its address), set into the hand-written sentence forms in which
licenses are named (identifier line, grant, name, address, file head), which gives
some hundreds of regexes.  One Aho-Corasick pass over a lower-cased text finds the
keywords; only rules one of whose keywords is there run, and every match of a rule
contains one.  Of the detections, taken by priority and then length, one that lies
within an accepted one is suppressed (accepted ones are kept as a staircase of
rising starts and ends, so that a text with very many stays cheap); the rest name
the text's labels.

Base places, where the words of a base phrase stand consecutively, are found
independently of the rules and always stay.  Null texts are empty; empty texts have
no words, labels or score.  Very long texts are worked on whole, one at a time.
Detections that tie in priority and length count by place, then label.  Repeated
rows and null ids are rows of their own; other columns, whatever their names, are
not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkshelf.llm.ragged import Texts, map_slices

WORD, GAP = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: label, keywords (every match of the name has one of them), name (a regex on lower-cased text), identifiers, address; fixed values.
FAMILIES: tuple[tuple[str, str, str, str, str], ...] = (
    ("mit", "mit", r"mit", r"mit(?:-0)?", r"opensource\.org/licenses?/mit"),
    ("apache", "apache", r"apache(?: software)?", r"apache-[12]\.[01]", r"apache\.org/licenses"),
    ("gpl", "gpl", r"gpl[ -]?v?[123]?(?:\.0)?", r"gpl-[123]\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl"),
    ("gpl", "general public", r"(?:gnu )?general public", r"gnu-gpl", r"gnu\.org/copyleft/gpl"),
    ("lgpl", "lgpl", r"lgpl[ -]?v?[23]?(?:\.[01])?", r"lgpl-[23]\.[01](?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?lgpl"),
    ("lgpl", "lesser general", r"(?:gnu )?lesser general public", r"gnu-lgpl", r"gnu\.org/copyleft/lesser"),
    ("agpl", "agpl", r"agpl[ -]?v?3?(?:\.0)?", r"agpl-[13]\.0(?:-only|-or-later)?", r"gnu\.org/licenses/agpl"),
    ("agpl", "affero", r"(?:gnu )?affero general public", r"gnu-agpl", r"affero\.org/oagpl"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation", r"gfdl-1\.[123](?:-only|-or-later)?", r"gnu\.org/licenses/fdl"),
    ("bsd", "bsd", r"(?:(?:two|three|four|[0234])[ -]clause |new |modified |simplified |revised )?bsd", r"(?:0bsd|bsd-[1234]-clause(?:-[a-z]+)?)", r"opensource\.org/licenses?/bsd"),
    ("isc", "isc", r"isc", r"isc", r"opensource\.org/licenses?/isc"),
    ("mpl", "mozilla", r"mozilla public", r"mozilla", r"mozilla\.org/mpl"),
    ("mpl", "mpl", r"mpl[ -]?v?[12]?(?:\.[01])?", r"mpl-[12]\.[01]", r"mozilla\.org/en-us/mpl"),
    ("epl", "eclipse", r"eclipse public", r"epl-[12]\.0", r"eclipse\.org/legal/epl"),
    ("edl", "eclipse", r"eclipse distribution", r"edl-1\.0", r"eclipse\.org/org/documents/edl"),
    ("cddl", "cddl", r"cddl", r"cddl-1\.[01]", r"opensource\.org/licenses?/cddl"),
    ("cddl", "common development", r"common development and distribution", r"sun-cddl", r"sun\.com/cddl"),
    ("cpl", "common public", r"common public", r"cpl-1\.0", r"opensource\.org/licenses?/cpl"),
    ("ipl", "ibm public", r"ibm public", r"ipl-1\.0", r"opensource\.org/licenses?/ibmpl"),
    ("artistic", "artistic", r"artistic", r"artistic-[12]\.0(?:-perl|-cl8)?", r"perlfoundation\.org/artistic"),
    ("perl", "perl", r"same terms as perl", r"perl", r"dev\.perl\.org/licenses"),
    ("zlib", "zlib", r"zlib(?:/libpng)?", r"zlib(?:-acknowledgement)?", r"zlib\.net/zlib_license"),
    ("libpng", "libpng", r"libpng", r"libpng(?:-2\.0)?", r"libpng\.org/pub/png/src/libpng-license"),
    ("boost", "boost", r"boost software", r"bsl-1\.0", r"boost\.org/license"),
    ("unlicense", "unlicense", r"unlicense", r"unlicense", r"unlicense\.org"),
    ("wtfpl", "wtfpl", r"wtfpl", r"wtfpl", r"wtfpl\.net"),
    ("cc0", "cc0", r"cc0", r"cc0-1\.0", r"creativecommons\.org/publicdomain/zero"),
    ("cc-by", "creative commons", r"creative commons attribution", r"cc-by-[1234]\.[05]", r"creativecommons\.org/licenses/by/"),
    ("cc-by-sa", "creative commons", r"creative commons attribution[ -]share[ -]?alike", r"cc-by-sa-[1234]\.[05]", r"creativecommons\.org/licenses/by-sa/"),
    ("cc-by-nc", "creative commons", r"creative commons attribution[ -]non[ -]?commercial", r"cc-by-nc-[1234]\.[05]", r"creativecommons\.org/licenses/by-nc/"),
    ("cc-by-nd", "creative commons", r"creative commons attribution[ -]no[ -]?deriv[a-z]*", r"cc-by-nd-[1234]\.[05]", r"creativecommons\.org/licenses/by-nd/"),
    ("cc-by-sa", "cc by|cc-by", r"cc[ -]by[ -]sa", r"cc-by-sa", r"creativecommons\.org/licenses/sa/"),
    ("cc-by-nc", "cc by|cc-by", r"cc[ -]by[ -]nc(?:[ -](?:sa|nd))?", r"cc-by-nc-(?:sa|nd)-[1234]\.[05]", r"creativecommons\.org/licenses/by-nc-(?:sa|nd)/"),
    ("cc-by-nd", "cc by|cc-by", r"cc[ -]by[ -]nd", r"cc-by-nd", r"creativecommons\.org/licenses/nd/"),
    ("cc-by", "cc by|cc-by", r"cc[ -]by", r"cc-by", r"creativecommons\.org/licenses/by(?:$|[ \n\"'>).,;])"),
    ("odbl", "odbl", r"odbl", r"odbl-1\.0", r"opendatacommons\.org/licenses/odbl"),
    ("odbl", "open database", r"open database", r"odc-odbl", r"opendatacommons\.org/odbl"),
    ("pddl", "pddl", r"pddl", r"pddl-1\.0", r"opendatacommons\.org/licenses/pddl"),
    ("ofl", "open font", r"(?:sil )?open font", r"ofl-1\.[01](?:-rfn|-no-rfn)?", r"scripts\.sil\.org/ofl"),
    ("eupl", "eupl", r"eupl", r"eupl-1\.[012]", r"joinup\.ec\.europa\.eu/[^ ]*eupl"),
    ("eupl", "european union public", r"european union public", r"eupl", r"ec\.europa\.eu/idabc/eupl"),
    ("cecill", "cecill", r"cecill(?:-[bc])?", r"cecill-(?:[bc]|[12]\.[01])", r"cecill\.info/licen"),
    ("ms-pl", "microsoft public", r"microsoft public", r"ms-pl", r"opensource\.org/licenses?/ms-pl"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal", r"ms-rl", r"opensource\.org/licenses?/ms-rl"),
    ("osl", "open software", r"open software", r"osl-[123]\.[01]", r"opensource\.org/licenses?/osl"),
    ("afl", "academic free", r"academic free", r"afl-[123]\.[012]", r"opensource\.org/licenses?/afl"),
    ("python", "python", r"python(?: software foundation)?", r"(?:psf|python)-2\.0(?:\.1)?", r"python\.org/(?:psf/license|[0-9.]+/license)"),
    ("php", "php", r"php", r"php-3\.0?1?", r"php\.net/license"),
    ("ruby", "ruby", r"ruby", r"ruby", r"ruby-lang\.org/[^ ]*license"),
    ("ncsa", "ncsa", r"(?:university of illinois/)?ncsa(?: open source)?", r"ncsa", r"opensource\.org/licenses?/ncsa"),
    ("openssl", "openssl", r"openssl", r"openssl(?:-standalone)?", r"openssl\.org/source/license"),
    ("postgresql", "postgresql", r"postgresql", r"postgresql", r"opensource\.org/licenses?/postgresql"),
    ("upl", "universal permissive", r"universal permissive", r"upl-1\.0", r"opensource\.org/licenses?/upl"),
    ("sspl", "server side public", r"server side public", r"sspl-1\.0", r"mongodb\.com/licensing/server-side-public"),
    ("busl", "business source", r"business source", r"busl-1\.1", r"mariadb\.com/bsl"),
    ("elastic", "elastic", r"elastic", r"elastic-2\.0", r"elastic\.co/licensing/elastic-license"),
    ("vim", "vim", r"vim", r"vim", r"vimdoc\.sourceforge\.net/htmldoc/uganda"),
    ("wxwindows", "wxwindows", r"wxwindows(?: library)?", r"wxwindows", r"wxwidgets\.org/about/licence"),
    ("proprietary", "all rights reserved", r"all rights reserved\.? proprietary", r"licenseref-proprietary", r"example\.com/proprietary"),
)
#: form, priority, confidence; {name}, {ids} and {url} are filled in.
FORMS = (
    (r"spdx-license-identifier:[ \t]*(?:[\w.+-]+ (?:or|and|with) )?(?:{ids})(?![\w-])", 100, 1.0),
    (r"(?:licen[sc]ed|released|distributed|available|provided) (?:under|by|with) (?:the )?(?:terms of (?:the )?)?{name}(?: public)?(?: licen[sc]e)?(?:,? v(?:ersion)? ?\d(?:\.\d)?)?(?!\w)", 80, 0.95),
    (r"(?<!\w){name}(?: public)? licen[sc]e(?:,? v(?:ersion)? ?\d(?:\.\d)?)?(?!\w)", 60, 0.9),
    (r"https?://(?:www\.)?{url}", 70, 0.9),
    (r"licen[sc]e ?[:=] ?[\"']?(?:the )?(?:{ids}|{name})(?![\w-])", 50, 0.8),
)
#: label, keyword (a word of every match), sentence (a blank stands for any white space and comment signs between words); fixed values.
BODIES: tuple[tuple[str, str, str], ...] = (
    ("mit", "granted", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"),
    ("mit", "substantial", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc", "granted", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("postgresql", "agreement", r"permission to use, copy, modify,? and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted"),
    ("ntp", "documentation", r"permission to use, copy, modify,? (?:and distribute|distribute,? and sell) this software and its documentation for any purpose (?:with or without fee )?is hereby granted(?: without fee)?,? provided that"),
    ("boost", "organization", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "endorse", r"neither the names? of .{1,120}? (?:nor|or) the names of (?:its|their|any|other) (?:contributors|copyright holders) may be used to endorse"),
    ("bsd", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache", "compliance", r"you may not use this (?:file|software|work|project) except in compliance with the license"),
    ("apache", "obtain", r"you may obtain a copy of the license at https?://(?:www\.)?apache\.org"),
    ("apache", "agreements", r"licensed to the apache software foundation \(asf\) under one or more contributor license agreements"),
    ("apache", "apache", r"this product includes software developed (?:by|at) the apache (?:software foundation|group)"),
    ("gpl", "redistribute", r"this (?:program|file|software|package|script) is free software[:;,] you can redistribute it and/or modify it under the terms of (?:version \d of )?the gnu general public license"),
    ("gpl", "received", r"you should have received a copy of the gnu general public license"),
    ("gpl", "freedom", r"the licenses for most software(?: and other practical works)? are designed to take away your freedom"),
    ("gpl", "copyleft", r"the gnu general public license is a free, copyleft license"),
    ("lgpl", "redistribute", r"this (?:library|program|file|software|package) is free software[:;,] you can redistribute it and/or modify it under the terms of (?:version [\d.]+ of )?the gnu (?:lesser|library) general public license"),
    ("lgpl", "received", r"you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("agpl", "redistribute", r"this (?:program|file|software|library) is free software[:;,] you can redistribute it and/or modify it under the terms of (?:version \d of )?the gnu affero general public license"),
    ("agpl", "received", r"you should have received a copy of the gnu affero general public license"),
    ("agpl", "interaction", r"remote network interaction; use with the gnu (?:affero )?general public license"),
    ("gfdl", "document", r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license"),
    ("mpl", "mozilla", r"this source code form is subject to the terms of the mozilla public license"),
    ("mpl", "mozilla", r"the contents of this file are subject to the mozilla public license"),
    ("mpl", "distributed", r"if a copy of the mpl was not distributed with this file, you can obtain one at"),
    ("cddl", "development", r"the contents of this file are subject to the terms of (?:either )?the (?:gnu general public license .{1,80}? or the )?common development and distribution license"),
    ("epl", "eclipse", r"(?:this program and the accompanying materials|all rights reserved\. this program and the accompanying materials) are made available under the terms of the eclipse public license"),
    ("edl", "eclipse", r"made available under the terms of the eclipse distribution license"),
    ("cpl", "common", r"made available under the terms of the common public license"),
    ("artistic", "conditions", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic", "modify", r"you can redistribute it and/or modify it under the (?:same )?terms (?:of|as) (?:the artistic license|perl itself)"),
    ("perl", "perl", r"(?:under|on) the same terms as perl itself"),
    ("zlib", "liable", r"this software is provided 'as-is', without any express or implied warranty\. in no event will the authors? be held liable"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such"),
    ("libpng", "png", r"the png reference library is supplied \"as is\"|this code is released under the libpng license"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "compile", r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("wtfpl", "want", r"do what the f[a-z*]+k you want to(?: public license)?"),
    ("cc0", "waived", r"to the extent possible under law, .{1,120}? (?:has|have) waived all copyright and related or neighbou?ring rights"),
    ("cc0", "deed", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc-by-nc", "noncommercial", r"(?:this work is )?licensed under (?:a|the) creative commons attribution-noncommercial(?:-[a-z]+)? \d\.\d"),
    ("cc-by-sa", "sharealike", r"(?:this work is )?licensed under (?:a|the) creative commons attribution-sharealike \d\.\d"),
    ("cc-by-nd", "noderivatives", r"(?:this work is )?licensed under (?:a|the) creative commons attribution-noderivatives \d\.\d"),
    ("ofl", "font", r"this font software is licensed under the sil open font license"),
    ("ofl", "reserved", r"no modified version of the font software may use the reserved font name"),
    ("python", "nonexclusive", r"psf hereby grants licensee a nonexclusive, royalty-free, world-wide license"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project"),
    ("ncsa", "granted", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files \(the \"?software\"?\), to deal with the software"),
    ("php", "php", r"this source file is subject to version [\d.]+ of the php license"),
    ("ruby", "ruby", r"you can redistribute it and/or modify it under (?:either the terms of the ruby license|the same terms as ruby itself)"),
    ("vim", "vim", r"vim is charityware"),
    ("busl", "production", r"the licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use"),
    ("elastic", "hosted", r"you may not provide the software to third parties as a hosted or managed service"),
    ("sspl", "functionality", r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("eupl", "licensed", r"licensed under the eupl, version 1\.[0-2]|licensed under the european union public licen[sc]e"),
    ("cecill", "cecill", r"this software is governed by the cecill(?:-[bc])? license under french law"),
    ("ms-pl", "microsoft", r"this license governs use of the accompanying software\..{1,120}? microsoft public license"),
    ("public-domain", "domain", r"(?:is|are|was|were|been) (?:hereby )?(?:placed|released|dedicated|put) (?:in|into|to) the public domain"),
    ("proprietary", "proprietary", r"(?:this software|this file|this document) is (?:the )?(?:confidential and )?proprietary (?:information|property) of"),
    ("proprietary", "prohibited", r"unauthorized copying of this file, via any medium,? is strictly prohibited"),
)
BETWEEN = r"[\s*#/>;|-]+"
BODY = (90, 0.97)  # priority, confidence


class Rules:
    def __init__(self, families=FAMILIES, forms=FORMS, bodies=BODIES):
        import ahocorasick

        self.rules = [(label, priority, sure, re.compile(form.format(name=f"(?:{name})", ids=ids, url=url))) for label, _, name, ids, url in families for form, priority, sure in forms]
        # keyword -> rules; an address or an identifier line has a keyword of its own
        gates: dict[str, list[int]] = {}
        for f, (_, keywords, *_rest) in enumerate(families):
            for k, (form, *_x) in enumerate(forms):
                gate = "spdx-license" if "spdx" in form else "://" if "{url}" in form else keywords if "{ids}" not in form else "licen"
                for word in gate.split("|"):
                    gates.setdefault(word, []).append(f * len(forms) + k)
        for label, word, sentence in bodies:
            gates.setdefault(word, []).append(len(self.rules))
            self.rules.append((label, *BODY, re.compile(sentence.replace(" ", BETWEEN), re.DOTALL)))
        self.automaton = ahocorasick.Automaton()
        for word, numbers in gates.items():
            self.automaton.add_word(word, numbers)
        self.automaton.make_automaton()
        self.base = [(label, re.compile(rf"(?<!{WORD}){GAP.join(phrase.split())}(?!{WORD})")) for phrase, label in BASE]

    def detect(self, low: str) -> list[tuple[int, int, str, float]]:
        """Accepted (start, end, label, confidence) in a lower-cased text."""
        active: set[int] = set()
        for _, numbers in self.automaton.iter(low):
            active.update(numbers)
        found = [(-rule[1], m.start() - m.end(), m.start(), m.end(), rule[0], rule[2]) for n in sorted(active) for rule in (self.rules[n],) for m in rule[3].finditer(low)]
        accepted: list[tuple[int, int, str, float]] = []
        starts: list[int] = []  # of accepted detections that no other accepted one contains, rising,
        ends: list[int] = []  # and so are their ends
        for _, _, a, b, label, sure in sorted(found):
            at = bisect_right(starts, a)
            if at and ends[at - 1] >= b:
                continue
            accepted.append((a, b, label, sure))
            low_at, high_at = bisect_left(starts, a), bisect_right(ends, b)
            starts[low_at : max(low_at, high_at)], ends[low_at : max(low_at, high_at)] = [a], [b]
        return sorted(accepted)


@lru_cache(1)
def rules() -> Rules:
    return Rules()


_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_any_word = re.compile(f"{WORD}+")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans of every row."""

    def work(part: pa.RecordBatch):
        texts, held = Texts(part.column("text")), rules()
        n_words = texts.counts(texts.runs(_WORD_BYTE[texts.data])[0])
        out: dict[str, list] = {c: [] for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
        for raw in texts.lists():
            low = raw.lower().decode()  # bytes.lower() folds A-Z alone
            places = [(m.start(), label) for label, regex in held.base for m in regex.finditer(low)] if "license" in low else []
            at = sorted(p for p, _ in places)
            found = held.detect(low)
            miss = 1.0
            for _, _, _, sure in found:
                miss *= 1 - sure
            for _ in places:
                miss *= 0.1
            base = {label for _, label in places}
            out["n_base"].append(len(places))
            out["first_word"].append(len(_any_word.findall(low[: at[0]])) if at else None)
            out["last_word"].append(len(_any_word.findall(low[: at[-1]])) if at else None)
            out["base_labels"].append(",".join(sorted(base)))
            out["labels"].append(",".join(sorted(base | {label for _, _, label, _ in found})))
            out["score"].append(1.0 - miss)
            out["spans"].append(",".join(f"{label}:{a}:{b}" for a, b, label, _ in found))
        kinds = {"n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "score": pa.float64()}
        return {"doc_id": part.column("doc_id"), "n_words": n_words.astype(np.int64)} | {c: pa.array(v, kinds.get(c, pa.string())) for c, v in out.items()}

    return map_slices(docs.selectExpr(f"CAST(`{id_col}` AS long) doc_id", f"`{text_col}` text"), "text", work, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string")
