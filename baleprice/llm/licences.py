"""Licence scans by sentence rules, with DataFrame functions.

A text is split into sentences, each normalised to its letters and digits and looked up among known licence sentences.
The identifiers found, in order, are matched against rules, ordered lists of sentences that may have others between.
Two readings are scanned, one where a line end ends a sentence and one where it is a space, for wrapped licence texts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# FIXED VALUES: sentences of published licences and licence notices, as written there.
SENTENCES = {
    "apache-2.0-under": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-2.0-use": "you may not use this file except in compliance with the License.",
    "apache-2.0-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-3.0-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software:",
    "gpl-3.0-later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                     "published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
                     "later version.",
    "gpl-published": "you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                     "published by the Free Software Foundation;",
    "gpl-2.0-either": "either version 2 of the License, or (at your option) any later version.",
    "lgpl-2.1-under": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "agpl-3.0-under": "This work is licensed under the GNU Affero General Public License, version 3.",
    "mit-under": "Licensed under the MIT License.",
    "mit-released": "Released under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and '
                 'associated documentation files (the "Software"), to deal in the Software without restriction, including '
                 'without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell '
                 'copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the '
                 'following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial "
                  "portions of the Software.",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
                    'LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                 "that the following conditions are met:",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                   "promote products derived from this software without specific prior written permission.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
                 "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc0-1.0": "Licensed under CC0 1.0.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-sa-4.0-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd-4.0": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-sa-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "all-rights": "All rights reserved.",
}
#: Licence, its sentences in order, and a licence that makes it superfluous.
RULES = (
    ("Apache-2.0", ("apache-2.0-under",), None),
    ("Apache-2.0", ("apache-2.0-header", "apache-2.0-use"), None),
    ("GPL-3.0-only", ("gpl-3.0-work",), None),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-3.0-later"), None),
    ("GPL-2.0-or-later", ("gpl-free", "gpl-published", "gpl-2.0-either"), None),
    ("LGPL-2.1-only", ("lgpl-2.1-under",), None),
    ("AGPL-3.0-only", ("agpl-3.0-under",), None),
    ("MIT", ("mit-under",), None),
    ("MIT", ("mit-released",), None),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty"), None),
    ("BSD-3-Clause", ("bsd-grant", "bsd-endorse"), None),
    ("BSD-2-Clause", ("bsd-grant",), "BSD-3-Clause"),
    ("ISC", ("isc-grant",), None),
    ("MPL-2.0", ("mpl-2.0-subject",), None),
    ("Unlicense", ("unlicense",), None),
    ("CC0-1.0", ("cc0-1.0",), None),
    ("CC-BY-4.0", ("cc-by-4.0",), None),
    ("CC-BY-4.0", ("cc-by-4.0-long",), None),
    ("CC-BY-SA-4.0", ("cc-by-sa-4.0",), None),
    ("CC-BY-SA-4.0", ("cc-by-sa-4.0-long",), None),
    ("CC-BY-NC-4.0", ("cc-by-nc-4.0",), None),
    ("CC-BY-ND-4.0", ("cc-by-nd-4.0",), None),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4.0",), None),
    ("All-rights-reserved", ("all-rights",), None),
)
#: What ends a sentence: any line end or only a blank line, by reading; and stops before a space or the end of the text.
_STOP = r"[.;:!?]+(?:[\x20\x09-\x0D]|$)"
_ENDS = {"lines": r"[\x0A-\x0D]+|" + _STOP, "wrapped": r"\n[\x20\x09\x0D]*\n|" + _STOP}


def normalised(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def _known() -> dict[str, str]:
    """Normalised known sentence to its identifier."""
    return {normalised(text): name for name, text in SENTENCES.items()}


def sentence_ids(text: Column, reading: str) -> Column:
    """The known sentences of a text, array of identifiers in order."""
    known = _known()
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), _ENDS[reading], "\x01")
    plain = F.regexp_replace(F.lower(marked), "[^a-z0-9\x01]+", " ")
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.transform(F.filter(F.split(plain, " ?\x01 ?"), lambda s: F.trim(s).isin(*known)),
                       lambda s: F.element_at(table, F.trim(s)))


def licences_of(ids: Column) -> Column:
    """The distinct licences whose rules the sequence meets, sorted."""
    line = F.concat(F.lit(" "), F.array_join(ids, "  "), F.lit(" "))
    met = F.array_distinct(F.array_compact(F.array(*[
        F.when(line.rlike(".*".join(f" {re.escape(s)} " for s in rule)), F.lit(name)) for name, rule, _ in RULES])))
    for name, _, beaten_by in RULES:
        if beaten_by:
            met = F.when(F.array_contains(met, beaten_by), F.array_remove(met, name)).otherwise(met)
    return F.array_sort(met)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, sentences (identifiers of the reading by lines, in order), licences (sorted).

    ``licences`` holds those of both readings. Null and empty texts have none; each row stands for itself, so ids may
    be null or repeated; a sentence that occurs twice is listed twice; whole texts are read; other columns are
    ignored; an empty table gives no rows."""
    found = docs.select(F.col(id_col), sentence_ids(F.col(text_col), "lines").alias("sentences"),
                        sentence_ids(F.col(text_col), "wrapped").alias("_wrapped"))
    return found.select(id_col, "sentences", F.array_sort(F.array_union(
        licences_of(F.col("sentences")), licences_of(F.col("_wrapped")))).alias("licences"))
