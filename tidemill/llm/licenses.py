"""Licence scans: sentences to identifiers, identifier sequences to ordered rules.

Native: every step is a DataFrame expression, evaluated row by row without a shuffle. The known sentences and the rules are fixed
lists of a few entries and travel in the plan as literals. A known sentence may stand in a line or be wrapped over the lines of a paragraph.
"""

from __future__ import annotations

from itertools import chain, count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known licence sentences, normalised (lower case, runs of other characters than a-z and 0-9 one blank), and their identifiers.
SENTENCES = {
    "licensed under cc by nc 4 0": "CC-BY-NC",
    "licensed under cc by 4 0": "CC-BY",
    "licensed under cc by sa 4 0": "CC-BY-SA",
    "this work is licensed under the gnu general public license version 3": "GPL3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "GPL-FREE",
    "licensed under the apache license version 2 0": "APACHE2",
    "you may not use this file except in compliance with the license": "APACHE2-USE",
    "released under the mit license": "MIT",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "MIT-GRANT",
    "the software is provided as is without warranty of any kind": "AS-IS",
    "redistribution and use in source and binary forms with or without modification are permitted": "BSD-GRANT",
    "all rights reserved": "RESERVED",
}
#: Ordered rules; a document meets a rule whose identifiers its own sequence has in this order. The first rule met decides.
RULES = (
    ("gpl-reserved", ("RESERVED", "GPL3")),
    ("gpl-3.0", ("GPL3",)),
    ("gpl", ("GPL-FREE",)),
    ("apache-2.0-full", ("APACHE2", "APACHE2-USE")),
    ("apache-2.0", ("APACHE2",)),
    ("mit-full", ("MIT-GRANT", "AS-IS")),
    ("mit", ("MIT",)),
    ("bsd", ("BSD-GRANT",)),
    ("cc-by-nc-4.0", ("CC-BY-NC",)),
    ("cc-by-sa-4.0", ("CC-BY-SA",)),
    ("cc-by-4.0", ("CC-BY",)),
    ("all-rights-reserved", ("RESERVED",)),
)


#: The sentences of the licences' own headers and texts, and their identifiers.
_MIT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
_GNU = "you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation either version {} of the license or at your option any later version"
_FREE = (("general public license", "3", "GPL3"), ("general public license", "2", "GPL2"), ("lesser general public license", "3", "LGPL3"), ("lesser general public license", "2 1", "LGPL2"), ("affero general public license", "3", "AGPL3"))
TEXTS = {
    "licensed under the apache license version 2 0 the license": "APACHE2",
    "the asf licenses this file to you under the apache license version 2 0 the license": "APACHE2",
    "apache license version 2 0 january 2004": "APACHE2",
    "apache license version 2 0 january 2004 http www apache org licenses": "APACHE2",
    "apache license version 2 0 january 2004 https www apache org licenses": "APACHE2",
    "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form": "APACHE2-GRANT",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "APACHE2-AS-IS",
    "see the license for the specific language governing permissions and limitations under the license": "APACHE2-SEE",
    "mit license": "MIT",
    "the mit license": "MIT",
    "the mit license mit": "MIT",
    _MIT: "MIT-GRANT",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MIT-NOTICE",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "AS-IS",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "MIT-LIABLE",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSD-GRANT",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSD-SOURCE",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSD-BINARY",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSD-NAME",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "BSD-AS-IS",
    **{f"this {x} is free software {_GNU.format(name, v)}": i for x in ("program", "library", "file") for name, v, i in _FREE},
    **{_GNU.format(name, v): i for name, v, i in _FREE},  # after "This program is free software;"
    "gnu general public license version 3 29 june 2007": "GPL3",
    "gnu general public license version 2 june 1991": "GPL2",
    "gnu lesser general public license version 3 29 june 2007": "LGPL3",
    "gnu lesser general public license version 2 1 february 1999": "LGPL2",
    "gnu affero general public license version 3 19 november 2007": "AGPL3",
    "this source code form is subject to the terms of the mozilla public license v": "MPL2",
    "mozilla public license version 2 0": "MPL2",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISC",
    "this is free and unencumbered software released into the public domain": "UNLICENSE",
    **{f"this work is licensed under {a}creative commons {name} 4 0 international license": i for a in ("a ", "the ") for name, i in (("attribution", "CC-BY"), ("attribution noncommercial", "CC-BY-NC"), ("attribution sharealike", "CC-BY-SA"))},
}
#: Rules for what the first rules leave open; these come before the last of them.
TEXT_RULES = (
    ("agpl-3.0", ("AGPL3",)),
    ("lgpl-3.0", ("LGPL3",)),
    ("lgpl-2.1", ("LGPL2",)),
    ("gpl-2.0", ("GPL2",)),
    ("apache-2.0", ("APACHE2-USE",)),
    ("apache-2.0", ("APACHE2-GRANT",)),
    ("mit", ("MIT-GRANT",)),
    ("mpl-2.0", ("MPL2",)),
    ("isc", ("ISC",)),
    ("unlicense", ("UNLICENSE",)),
)
#: Where a wrapped sentence ends: at . ! ? ; before white space, at a colon that ends a line, before a line without a-z and 0-9.
HARD = r"[.!?;](?=[ \t\n\r]|$)|:(?=[ \t]*[\n\r])|(?:\r\n|\r(?!\n)|\n)(?=[^a-z0-9\n\r]*[\n\r])"
#: A line of its own, whatever follows without a blank line.
OWNER = r"((?:^|[\n\r])[^a-z0-9\n\r]*copyright[ \t]*(?:\(c\)|©|[0-9])[^\n\r]*)"


def sentences(text: Column) -> Column:
    """Normalised sentences, split at line ends and after . ! ? ; before white space; those without a-z or 0-9 are dropped.

    An array of arrays: the lines of a wrapped sentence are together.
    """
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts = F.split(F.regexp_replace(F.coalesce(lower, F.lit("")), OWNER, "\n\n$1\n\n"), HARD)
    norm = lambda s: F.btrim(F.regexp_replace(s, "[^a-z0-9]+", " "))
    return F.transform(parts, lambda p: F.filter(F.transform(F.split(p, r"[\n\r]+"), norm), lambda s: s != ""))


def scan(docs: DataFrame, text_col: str = "text", known: dict[str, str] = SENTENCES | TEXTS, rules: tuple = (*RULES[:-1], *TEXT_RULES, RULES[-1])) -> DataFrame:
    """docs with n_sentences, sentence_ids (the known sentences of the whole text in order, comma-joined), n_known and license.

    Columns of docs with these names are replaced. n_sentences counts lines of wrapped sentences one by one. A sentence that is known as a
    whole counts once, else each of its known lines does. license: the first rule whose identifiers occur in order, other sentences
    between them allowed; none if no rule is met. Null and empty texts have no sentence. An empty table gives an empty result;
    repeated rows each count, long texts are read whole, and other columns of any name stay.
    """
    new = ["n_sentences", "sentence_ids", "n_known", "license"]
    lower = {c.lower() for c in docs.columns}
    split, hits, joined = (next(n for k in count() if (n := f"{base}{k or ''}") not in lower) for base in ("split", "hits", "joined"))
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(known.items())])
    cut = docs.select(*[c for c in docs.columns if c not in new], sentences(F.col(text_col)).alias(split))
    look = lambda s: F.try_element_at(table, s)
    whole = lambda g: F.when(F.size(g) > 1, look(F.array_join(g, " ")))
    found = F.transform(split, lambda g: F.when(whole(g).isNotNull(), F.array(whole(g))).otherwise(F.transform(g, look)))
    known_ids = cut.select("*", F.filter(F.flatten(found), lambda x: x.isNotNull()).alias(hits))
    ruled = known_ids.select("*", F.concat(F.lit(","), F.array_join(hits, ",,"), F.lit(",")).alias(joined))
    verdict = F.lit("none")
    for name, ids in reversed(rules):
        verdict = F.when(F.col(joined).like("%," + ",%,".join(x.replace("_", r"\_") for x in ids) + ",%"), F.lit(name)).otherwise(verdict)
    return ruled.select(
        *[c for c in cut.columns if c != split],
        F.size(F.flatten(split)).cast("bigint").alias("n_sentences"),
        F.array_join(hits, ",").alias("sentence_ids"),
        F.size(hits).cast("bigint").alias("n_known"),
        verdict.alias("license"),
    )
