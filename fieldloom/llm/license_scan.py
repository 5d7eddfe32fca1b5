"""License scans: ordered signature rules behind a keyword gate, overlaps resolved by priority.

Each license of ``LICENSES`` has hand-written expressions of its names, an SPDX tag and addresses;
``rules`` lists them as (keyword, expression, label, priority, weight). A text is searched only with
the rules whose keyword its lower-cased form contains, and texts that hold none of the keywords are
only counted. Detections are then ordered, and one inside a detection of the same or a higher
priority is dropped, so that "GNU Affero General Public License" is no GPL and a tag beats the name
in it. The base phrases are found on their own and stay whatever the rules say.

Empty and null texts have no words and no labels; score is 0. Rows are judged one by one, so
repeats get equal results. Other columns are ignored.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Phrases of the base, as words, and their labels.
PHRASES = {"mit": ["under", "the", "mit", "license"], "apache-2": ["apache", "license", "version", "2"], "cc-by-nc": ["cc", "by", "nc"]}
#: Priorities: a tag states the license, a text or address names it, a name may be a mention.
TAG, TEXT, NAME, HINT = 4, 3, 2, 1
V = r"(?:,?\s*(?:version|v\.?)?\s*)"
#: label: (SPDX ids, expressions of names, expressions of texts and addresses). Spaces match any white space.
LICENSES = {
    "mit": (["MIT"], [r"\bMIT licen[cs]e\b", r"\bMIT/X11 licen[cs]e\b", r"\bexpat licen[cs]e\b", r"\blicen[cs]ed under (?:the )?MIT\b"], [r"permission is hereby granted, free of charge, to any person obtaining a copy", r"opensource\.org/licenses?/mit\b"]),
    "mit-0": (["MIT-0"], [r"\bMIT no attribution licen[cs]e\b", r"\bMIT-0 licen[cs]e\b"], [r"opensource\.org/licenses?/mit-0"]),
    "apache-2": (["Apache-2.0"], [rf"\bapache(?: software)? licen[cs]e{V}2(?:\.0)?\b", r"\bapache-2(?:\.0)?\b licen[cs]e", r"\bASL 2(?:\.0)?\b licen[cs]e"], [r"apache\.org/licenses/LICENSE-2\.0", r"opensource\.org/licenses?/apache-2\.0"]),
    "apache-1.1": (["Apache-1.1"], [rf"\bapache(?: software)? licen[cs]e{V}1\.1\b"], [r"apache\.org/licenses/LICENSE-1\.1"]),
    "apache": ([], [r"\bapache(?: software)? licen[cs]e\b"], []),
    "gpl-2": (["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-2.0+"], [rf"\bGNU general public licen[cs]e{V}2(?:\.0)?\b", r"\bGPL ?v?2(?:\.0)?\+?\b(?=.{0,20}licen)", r"\bGPLv2\+?\b"], [r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0", r"opensource\.org/licenses?/gpl-2\.0", r"either version 2 of the licen[cs]e, or \(at your option\)"]),
    "gpl-3": (["GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-3.0+"], [rf"\bGNU general public licen[cs]e{V}3(?:\.0)?\b", r"\bGPLv3\+?\b", r"\bGPL-3\.0\b licen[cs]e"], [r"gnu\.org/licenses/gpl-3\.0", r"opensource\.org/licenses?/gpl-3\.0", r"either version 3 of the licen[cs]e, or \(at your option\)"]),
    "gpl": ([], [r"\bGNU general public licen[cs]e\b", r"\bGNU GPL\b", r"\bunder the GPL\b"], [r"gnu\.org/(?:licenses/gpl|copyleft/gpl)\.(?:html|txt)"]),
    "lgpl-2.1": (["LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-2.1+"], [rf"\bGNU lesser general public licen[cs]e{V}2\.1\b", r"\bLGPLv2\.1\+?\b"], [r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1", r"opensource\.org/licenses?/lgpl-2\.1"]),
    "lgpl-2": (["LGPL-2.0", "LGPL-2.0-only", "LGPL-2.0-or-later"], [rf"\bGNU library general public licen[cs]e{V}2(?:\.0)?\b"], [r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.0"]),
    "lgpl-3": (["LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"], [rf"\bGNU lesser general public licen[cs]e{V}3(?:\.0)?\b", r"\bLGPLv3\+?\b"], [r"gnu\.org/licenses/lgpl-3\.0", r"opensource\.org/licenses?/lgpl-3\.0"]),
    "lgpl": ([], [r"\bGNU (?:lesser|library) general public licen[cs]e\b", r"\bGNU LGPL\b"], []),
    "agpl-3": (["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"], [rf"\bGNU affero general public licen[cs]e{V}3(?:\.0)?\b", r"\bAGPLv3\+?\b"], [r"gnu\.org/licenses/agpl-3\.0", r"opensource\.org/licenses?/agpl-3\.0"]),
    "agpl": ([], [r"\b(?:GNU )?affero general public licen[cs]e\b", r"\bGNU AGPL\b"], []),
    "gfdl": (["GFDL-1.1", "GFDL-1.2", "GFDL-1.3", "GFDL-1.3-or-later"], [r"\bGNU free documentation licen[cs]e\b", r"\bGFDL licen[cs]e\b"], [r"gnu\.org/licenses/fdl"]),
    "bsd-2": (["BSD-2-Clause"], [r"\bBSD[ -]2[ -]clause\b", r"\b(?:2|two)[ -]clause BSD\b", r"\bsimplified BSD licen[cs]e\b", r"\bfreebsd licen[cs]e\b"], [r"opensource\.org/licenses?/bsd-2-clause"]),
    "bsd-3": (["BSD-3-Clause"], [r"\bBSD[ -]3[ -]clause\b", r"\b(?:3|three)[ -]clause BSD\b", r"\b(?:new|revised|modified) BSD licen[cs]e\b"], [r"opensource\.org/licenses?/bsd-3-clause", r"neither the name of .{1,80} nor the names of its contributors"]),
    "bsd-4": (["BSD-4-Clause"], [r"\bBSD[ -]4[ -]clause\b", r"\boriginal BSD licen[cs]e\b"], [r"all advertising materials mentioning features or use of this software"]),
    "bsd": ([], [r"\bBSD(?:-style)? licen[cs]e\b"], [r"redistribution and use in source and binary forms, with or without modification"]),
    "0bsd": (["0BSD"], [r"\bzero[ -]clause BSD\b", r"\b0BSD licen[cs]e\b"], [r"opensource\.org/licenses?/0bsd"]),
    "isc": (["ISC"], [r"\bISC licen[cs]e\b"], [r"opensource\.org/licenses?/isc\b", r"permission to use, copy, modify, and/or distribute this software for any purpose"]),
    "mpl-1.1": (["MPL-1.1"], [rf"\bmozilla public licen[cs]e{V}1\.1\b"], [r"mozilla\.org/MPL/1\.1", r"mozilla\.org/MPL/MPL-1\.1"]),
    "mpl-2": (["MPL-2.0"], [rf"\bmozilla public licen[cs]e{V}2(?:\.0)?\b", r"\bMPL 2\.0\b licen[cs]e"], [r"mozilla\.org/(?:en-US/)?MPL/2\.0", r"opensource\.org/licenses?/mpl-2\.0"]),
    "mpl": ([], [r"\bmozilla public licen[cs]e\b"], []),
    "epl-1": (["EPL-1.0"], [rf"\beclipse public licen[cs]e{V}1(?:\.0)?\b"], [r"eclipse\.org/legal/epl-v10"]),
    "epl-2": (["EPL-2.0"], [rf"\beclipse public licen[cs]e{V}2(?:\.0)?\b"], [r"eclipse\.org/legal/epl-2\.0", r"eclipse\.org/legal/epl-v20"]),
    "epl": ([], [r"\beclipse public licen[cs]e\b"], []),
    "edl-1": (["BSD-3-Clause-EDL"], [r"\beclipse distribution licen[cs]e\b"], [r"eclipse\.org/org/documents/edl-v10"]),
    "cddl-1": (["CDDL-1.0", "CDDL-1.1"], [r"\bcommon development and distribution licen[cs]e\b", r"\bCDDL licen[cs]e\b"], [r"opensource\.org/licenses?/cddl-1\.0"]),
    "cpl-1": (["CPL-1.0"], [r"\bcommon public licen[cs]e\b"], [r"opensource\.org/licenses?/cpl1\.0"]),
    "eupl": (["EUPL-1.1", "EUPL-1.2"], [r"\beuropean union public licen[cs]e\b", r"\bEUPL licen[cs]e\b"], [r"joinup\.ec\.europa\.eu/.{0,40}eupl"]),
    "artistic-1": (["Artistic-1.0", "Artistic-1.0-Perl"], [rf"\bartistic licen[cs]e{V}1(?:\.0)?\b"], [r"opensource\.org/licenses?/artistic-1\.0"]),
    "artistic-2": (["Artistic-2.0"], [rf"\bartistic licen[cs]e{V}2(?:\.0)?\b"], [r"opensource\.org/licenses?/artistic-2\.0", r"perlfoundation\.org/artistic_license_2_0"]),
    "artistic": ([], [r"\bartistic licen[cs]e\b"], []),
    "zlib": (["Zlib"], [r"\bzlib(?:/libpng)? licen[cs]e\b"], [r"opensource\.org/licenses?/zlib", r"this software is provided 'as-is', without any express or implied warranty"]),
    "libpng": (["libpng-2.0", "Libpng"], [r"\blibpng licen[cs]e\b"], [r"libpng\.org/pub/png/src/libpng-license"]),
    "boost-1": (["BSL-1.0"], [r"\bboost software licen[cs]e\b"], [r"boost\.org/LICENSE_1_0\.txt", r"opensource\.org/licenses?/bsl-1\.0"]),
    "busl-1.1": (["BUSL-1.1"], [r"\bbusiness source licen[cs]e\b"], [r"mariadb\.com/bsl11"]),
    "sspl-1": (["SSPL-1.0"], [r"\bserver side public licen[cs]e\b"], [r"mongodb\.com/licensing/server-side-public-license"]),
    "elastic-2": (["Elastic-2.0"], [r"\belastic licen[cs]e\b"], [r"elastic\.co/licensing/elastic-license"]),
    "unlicense": (["Unlicense"], [r"\bthe unlicen[cs]e\b", r"\breleased under (?:the )?unlicen[cs]e\b"], [r"unlicense\.org\b", r"this is free and unencumbered software released into the public domain"]),
    "wtfpl": (["WTFPL"], [r"\bdo what the f\S* you want to public licen[cs]e\b", r"\bWTFPL licen[cs]e\b"], [r"wtfpl\.net"]),
    "cc0-1": (["CC0-1.0"], [r"\bCC0(?:[ -]1\.0)?\b(?: universal)? licen[cs]e\b", r"\bcreative commons zero\b", r"\blicen[cs]ed under CC0\b"], [r"creativecommons\.org/publicdomain/zero"]),
    "cc-by": (["CC-BY-1.0", "CC-BY-2.0", "CC-BY-2.5", "CC-BY-3.0", "CC-BY-4.0"], [r"\bcreative commons attribution(?: [1-4]\.[05])?(?: international| unported| generic)?(?: licen[cs]e)?\b(?!-)", r"\blicen[cs]ed under CC[ -]BY\b(?![ -](?:NC|SA|ND))"], [r"creativecommons\.org/licenses/by/"]),
    "cc-by-sa": (["CC-BY-SA-2.0", "CC-BY-SA-2.5", "CC-BY-SA-3.0", "CC-BY-SA-4.0"], [r"\bcreative commons attribution[ -]share ?alike\b", r"\bCC[ -]BY[ -]SA\b"], [r"creativecommons\.org/licenses/by-sa/"]),
    "cc-by-nd": (["CC-BY-ND-3.0", "CC-BY-ND-4.0"], [r"\bcreative commons attribution[ -]no ?deriv", r"\bCC[ -]BY[ -]ND\b"], [r"creativecommons\.org/licenses/by-nd/"]),
    "cc-by-nc": (["CC-BY-NC-2.0", "CC-BY-NC-3.0", "CC-BY-NC-4.0"], [r"\bcreative commons attribution[ -]non-?commercial\b(?![ -](?:share|no ?deriv))", r"\bCC[ -]BY[ -]NC\b(?![ -](?:SA|ND))"], [r"creativecommons\.org/licenses/by-nc/"]),
    "cc-by-nc-sa": (["CC-BY-NC-SA-3.0", "CC-BY-NC-SA-4.0"], [r"\bcreative commons attribution[ -]non-?commercial[ -]share ?alike\b", r"\bCC[ -]BY[ -]NC[ -]SA\b"], [r"creativecommons\.org/licenses/by-nc-sa/"]),
    "cc-by-nc-nd": (["CC-BY-NC-ND-3.0", "CC-BY-NC-ND-4.0"], [r"\bcreative commons attribution[ -]non-?commercial[ -]no ?deriv", r"\bCC[ -]BY[ -]NC[ -]ND\b"], [r"creativecommons\.org/licenses/by-nc-nd/"]),
    "cc": ([], [r"\bcreative commons licen[cs]e\b"], []),
    "ofl-1.1": (["OFL-1.0", "OFL-1.1"], [r"\bSIL open font licen[cs]e\b", r"\bopen font licen[cs]e\b"], [r"scripts\.sil\.org/OFL", r"openfontlicense\.org"]),
    "odbl-1": (["ODbL-1.0"], [r"\bopen (?:data commons open )?database licen[cs]e\b", r"\bODbL licen[cs]e\b"], [r"opendatacommons\.org/licenses/odbl"]),
    "pddl-1": (["PDDL-1.0"], [r"\bpublic domain dedication and licen[cs]e\b"], [r"opendatacommons\.org/licenses/pddl"]),
    "odc-by": (["ODC-By-1.0"], [r"\bopen data commons attribution licen[cs]e\b"], [r"opendatacommons\.org/licenses/by"]),
    "psf-2": (["PSF-2.0", "Python-2.0"], [r"\bpython software foundation licen[cs]e\b", r"\bPSF licen[cs]e\b"], [r"python\.org/.{0,20}license"]),
    "php-3": (["PHP-3.0", "PHP-3.01"], [r"\bPHP licen[cs]e\b"], [r"php\.net/license"]),
    "ruby": (["Ruby"], [r"\bruby licen[cs]e\b", r"\bruby's licen[cs]e\b"], [r"ruby-lang\.org/.{0,20}license"]),
    "openssl": (["OpenSSL"], [r"\bopenssl licen[cs]e\b"], [r"openssl\.org/source/license"]),
    "vim": (["Vim"], [r"\bvim licen[cs]e\b"], []),
    "curl": (["curl"], [r"\bcurl licen[cs]e\b"], [r"curl\.(?:se|haxx\.se)/docs/copyright"]),
    "postgresql": (["PostgreSQL"], [r"\bpostgresql licen[cs]e\b"], [r"postgresql\.org/about/licen[cs]e"]),
    "ncsa": (["NCSA"], [r"\b(?:university of illinois/)?NCSA open source licen[cs]e\b"], [r"opensource\.org/licenses?/ncsa"]),
    "afl-3": (["AFL-3.0"], [r"\bacademic free licen[cs]e\b"], [r"opensource\.org/licenses?/afl-3\.0"]),
    "osl-3": (["OSL-3.0"], [r"\bopen software licen[cs]e\b"], [r"opensource\.org/licenses?/osl-3\.0"]),
    "ms-pl": (["MS-PL"], [r"\bmicrosoft public licen[cs]e\b"], [r"opensource\.org/licenses?/ms-pl"]),
    "ms-rl": (["MS-RL"], [r"\bmicrosoft reciprocal licen[cs]e\b"], [r"opensource\.org/licenses?/ms-rl"]),
    "upl-1": (["UPL-1.0"], [r"\buniversal permissive licen[cs]e\b"], [r"oss\.oracle\.com/licenses/upl"]),
    "mulan-2": (["MulanPSL-2.0"], [r"\bmulan permissive software licen[cs]e\b", r"\bmulan PSL\b licen[cs]e"], [r"license\.coscl\.org\.cn/MulanPSL2"]),
    "cecill": (["CECILL-2.1", "CECILL-B", "CECILL-C"], [r"\bCeCILL(?:-[BC])? licen[cs]e\b", r"\blicence CeCILL\b"], [r"cecill\.info/licences"]),
    "lppl": (["LPPL-1.3c"], [r"\blatex project public licen[cs]e\b"], [r"latex-project\.org/lppl"]),
    "etalab-2": (["etalab-2.0"], [r"\blicence ouverte\b", r"\betalab open licen[cs]e\b"], [r"etalab\.gouv\.fr/licence-ouverte"]),
    "ogl-3": (["OGL-UK-3.0"], [r"\bopen government licen[cs]e\b"], [r"nationalarchives\.gov\.uk/doc/open-government-licence"]),
    "openrail": ([], [r"\b(?:creativeml )?open ?RAIL(?:-M|\+\+-M)? licen[cs]e\b", r"\bresponsible AI licen[cs]e\b"], [r"licenses\.ai\b"]),
    "blueoak-1": (["BlueOak-1.0.0"], [r"\bblue oak model licen[cs]e\b"], [r"blueoakcouncil\.org/license"]),
    "jsr-json": (["JSON"], [r"\bJSON licen[cs]e\b"], [r"the software shall be used for good, not evil"]),
    "public-domain": ([], [r"\b(?:released|dedicated|placed|is) (?:in|into|to) the public domain\b"], [r"creativecommons\.org/publicdomain/mark"]),
    "proprietary": ([], [r"\ball rights reserved\b", r"\bproprietary licen[cs]e\b", r"\bend[ -]user licen[cs]e agreement\b"], []),
}


def _keyword(expression: str) -> str:
    """A literal that each match holds: the longest run of plain letters, from the part before any choice."""
    import re

    plain = re.sub(r"\(\?[^()]*\([^()]*\)[^()]*\)[?*]?|\([^()]*\)[?*]?|\[[^\]]*\]|\.?\{[^}]*\}|\\[a-zA-Z][*+?]?|.\?|\\(?=\W)", lambda m: "" if m[0] == "\\" else "\0", expression)
    plain = plain.split("|")[0] if "|" in plain else plain
    return max(re.findall(r"[A-Za-z.]+", plain), key=len, default="").strip(".").lower()


def _spaced(expression: str) -> str:
    """Spaces match any white space: an optional one may be missing, one beside a hyphen in a class may be that instead."""
    return expression.replace("[ -]", r"(?:\s+|-)").replace(" ?", r"\s*").replace(" ", r"\s+")


def rules() -> list[dict]:
    """Every rule, in order: keyword, expression, label, priority, weight."""
    out = []
    for label, (ids, names, texts) in LICENSES.items():
        made = [(rf"spdx-license-identifier:\s*{x.replace('.', chr(92) + '.').replace('+', chr(92) + '+')}(?![\w.+-])", TAG, 1.0, "spdx-license-identifier") for x in ids]
        made += [(x, TEXT, 0.95, None) for x in texts] + [(x, NAME if ids or texts else HINT, 0.9 if ids or texts else 0.6, None) for x in names]
        out += [{"kw": kw or _keyword(x), "re": "(?i)" + _spaced(x), "label": label, "prio": prio, "weight": weight} for x, prio, weight, kw in made]
    return [r | {"rank": i} for i, r in enumerate(out)]


def gates() -> list[str]:
    """What texts must hold one of to be searched at all: the keywords of the rules, less those that hold another."""
    all_ = {r["kw"] for r in rules()}
    return sorted(k for k in all_ if not any(o != k and o in k for o in all_))


def _gate(text: Column) -> Column:
    listed = F.from_json(F.lit(json.dumps(gates())), "array<string>")
    return shared.let(F.lower(text), lambda low: F.exists(listed, lambda g: F.contains(low, g)))


def _gap() -> str:
    return r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _base_gate() -> str:
    return "(?i)" + "|".join(_gap().join(p) for p in PHRASES.values())


def _places(words: Column, phrase: list[str]) -> Column:
    here = lambda x, i: reduce(lambda a, b: a & b, [x == phrase[0], *[F.coalesce(F.get(words, i + j) == w, F.lit(False)) for j, w in enumerate(phrase) if j]])
    return F.filter(F.transform(words, lambda x, i: F.when(here(x, i), i)), lambda x: x.isNotNull())


FOUND = "array<struct<s:int,e:int,label:string,prio:int,weight:double>>"


def detections(text: Column) -> Column:
    """What the rules find in a text that passed the gate, in order of place, suppressed ones dropped."""
    table = F.from_json(F.lit(json.dumps(rules())), "array<struct<kw:string,re:string,label:string,prio:int,weight:double,rank:int>>")
    hit = lambda r: F.transform(_spans(text, r.re), lambda s: F.struct(s.s.alias("s"), (-s.e).alias("ne"), (-r.prio).alias("np"), r["rank"].alias("rank"), r.label.alias("label"), r.weight.alias("weight")))
    some = shared.let(F.lower(text), lambda low: F.flatten(F.transform(F.filter(table, lambda r: F.contains(low, r.kw)), hit)))
    start = F.struct(shared.nothing(FOUND).alias("kept"), F.array(*[F.lit(-1)] * TAG).alias("to"))

    def step(acc: Column, x: Column) -> Column:
        # In this order what starts earlier, or reaches further, comes first: x lies inside an earlier one of its priority or above iff that one's end isn't before its own.
        inside = F.array_max(F.slice(acc.to, -x.np, F.lit(TAG))) >= -x.ne
        one = F.struct(x.s.alias("s"), (-x.ne).alias("e"), x.label.alias("label"), (-x.np).alias("prio"), x.weight.alias("weight"))
        to = F.transform(acc.to, lambda t, i: F.when(i == -x.np - 1, F.greatest(t, -x.ne)).otherwise(t))
        return F.struct(F.when(inside, acc.kept).otherwise(F.concat(acc.kept, F.array(one))).alias("kept"), to.alias("to"))

    return F.aggregate(F.array_sort(some), start, step, lambda acc: acc.kept)


def _spans(text: Column, pattern: Column) -> Column:
    start = F.struct(F.lit(0).alias("at"), shared.nothing("array<struct<s:int,e:int>>").alias("got"))
    both = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), lambda b, m: F.struct(F.length(b).alias("b"), F.length(m).alias("n")))
    step = lambda acc, x: F.struct((acc.at + x.b + x.n).alias("at"), F.concat(acc.got, F.array(F.struct((acc.at + x.b).alias("s"), (acc.at + x.b + x.n).alias("e")))).alias("got"))
    return F.when(F.rlike(text, pattern), F.aggregate(F.filter(both, lambda x: x.n.isNotNull()), start, step, lambda acc: acc.got)).otherwise(shared.nothing("array<struct<s:int,e:int>>"))


def scan(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_words, base places and labels, detections, labels and score."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = df.select("doc_id", "text", F.regexp_count("text", F.lit(shared.WORD)).cast("long").alias("n_words"), F.col("text").rlike(_base_gate()).alias("__base"), _gate(F.col("text")).alias("__gate"))
    words = F.when(F.col("__base"), shared.words(shared.ascii_lower(F.col("text")), shared.WORD)).otherwise(shared.nothing("array<string>"))
    df = df.withColumn("__w", words).withColumn("found", F.when(F.col("__gate"), detections(F.col("text"))).otherwise(shared.nothing(FOUND)))
    df = df.select("doc_id", "n_words", "found", *[_places(F.col("__w"), p).alias(f"__p{i}") for i, p in enumerate(PHRASES.values())])
    every = [F.col(f"__p{i}") for i in range(len(PHRASES))]
    base = F.array_sort(F.concat(*[F.when(F.size(p) > 0, F.array(F.lit(k))).otherwise(shared.nothing("array<string>")) for k, p in zip(PHRASES, every, strict=True)]))
    df = df.select("doc_id", "n_words", "found", F.array_sort(F.concat(*every)).alias("__all"), base.alias("__b"))
    labels = F.array_sort(F.array_union("__b", F.transform("found", lambda x: x.label)))
    weight = F.greatest(F.when(F.size("__b") > 0, F.lit(1.0)).otherwise(F.lit(0.0)), F.coalesce(F.array_max(F.transform("found", lambda x: x.weight)), F.lit(0.0)))
    return df.select(
        "doc_id", "n_words", F.size("__all").cast("long").alias("n_base"), F.array_min("__all").cast("long").alias("first_word"), F.array_max("__all").cast("long").alias("last_word"),
        F.array_join("__b", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), weight.alias("score"), "found",
    )


def op2(docs: DataFrame) -> DataFrame:
    return scan(docs).drop("found")
