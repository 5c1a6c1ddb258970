"""License scans: ordered signature rules with a keyword gate, priorities and containment suppression.

Each rule is a regular expression with a label, a priority and a keyword: a literal that all its
matches hold once their runs of white space are single spaces. A text is lower-cased once; a rule
is tried only if its keyword occurs, and no other gate stands before the rules. Detections are
resolved in order of priority: one that lies within the interval of a kept detection of equal or
higher priority is suppressed. The base detections (four phrases over words) always stay.
"""

from __future__ import annotations

import bisect
import re
from collections import defaultdict
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

OUT = "doc_id string, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label:string,rule:string,start:int,end:int,confidence:double>>"

#: Phrases and labels that the contract fixes.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Rule(NamedTuple):
    name: str
    label: str
    priority: int
    confidence: float
    keyword: str
    regex: str


V = r"(?:,?\s+(?:version|v\.?)?\s*|-|\s*v)"  # between a name and its version
ORLATER = r"(?:\s*(?:\+|-or-later|or\s+(?:\(at\s+your\s+option\)\s+)?(?:any\s+)?later(?:\s+version)?|or\s+newer))"

#: name, keyword, full-name pattern, versions, labels, addresses: every family gives several rules below.
FAMILIES = [
    ("agpl", "affero", r"(?:gnu\s+)?affero\s+general\s+public\s+licen[sc]e", ["1.0", "3.0"], r"agpl", r"gnu\.org/licenses/agpl"),
    ("lgpl", "gnu", r"gnu\s+(?:lesser|library)\s+general\s+public\s+licen[sc]e", ["2.0", "2.1", "3.0"], r"lgpl", r"gnu\.org/licenses/lgpl"),
    ("gpl", "gnu", r"gnu\s+general\s+public\s+licen[sc]e", ["1.0", "2.0", "3.0"], r"gpl", r"gnu\.org/licenses/(?:old-licenses/)?gpl"),
    ("gfdl", "gnu", r"gnu\s+free\s+documentation\s+licen[sc]e", ["1.1", "1.2", "1.3"], r"gfdl", r"gnu\.org/licenses/fdl"),
    ("apache", "apache", r"apache\s+(?:software\s+)?licen[sc]e", ["1.0", "1.1", "2.0"], r"apache", r"apache\.org/licenses/license-2\.0"),
    ("mit", "mit", r"(?:the\s+)?mit\s+licen[sc]e", [], r"mit", r"opensource\.org/licenses/mit"),
    ("mpl", "mozilla", r"mozilla\s+public\s+licen[sc]e", ["1.0", "1.1", "2.0"], r"mpl", r"mozilla\.org/mpl"),
    ("epl", "eclipse", r"eclipse\s+public\s+licen[sc]e", ["1.0", "2.0"], r"epl", r"eclipse\.org/legal/epl"),
    ("edl", "eclipse", r"eclipse\s+distribution\s+licen[sc]e", ["1.0"], r"edl", r"eclipse\.org/org/documents/edl"),
    ("cddl", "development", r"common\s+development\s+and\s+distribution\s+licen[sc]e", ["1.0", "1.1"], r"cddl", r"opensource\.org/licenses/cddl"),
    ("cpl", "common", r"common\s+public\s+licen[sc]e", ["1.0"], r"cpl", r"opensource\.org/licenses/cpl"),
    ("ipl", "ibm", r"ibm\s+public\s+licen[sc]e", ["1.0"], r"ipl", r"opensource\.org/licenses/ipl"),
    ("artistic", "artistic", r"(?:perl\s+)?artistic\s+licen[sc]e", ["1.0", "2.0"], r"artistic", r"perlfoundation\.org/artistic"),
    ("bsl", "boost", r"boost\s+software\s+licen[sc]e", ["1.0"], r"bsl", r"boost\.org/license"),
    ("busl", "business", r"business\s+source\s+licen[sc]e", ["1.0", "1.1"], r"busl", r"mariadb\.com/bsl"),
    ("sspl", "server side", r"server\s+side\s+public\s+licen[sc]e", ["1"], r"sspl", r"mongodb\.com/licensing/server-side"),
    ("elastic", "elastic", r"elastic\s+licen[sc]e", ["1.0", "2.0"], r"elastic", r"elastic\.co/licensing"),
    ("eupl", "european", r"european\s+union\s+public\s+licen[sc]e", ["1.0", "1.1", "1.2"], r"eupl", r"joinup\.ec\.europa\.eu/\S*eupl"),
    ("osl", "open software", r"open\s+software\s+licen[sc]e", ["1.0", "2.0", "3.0"], r"osl", r"opensource\.org/licenses/osl"),
    ("afl", "academic", r"academic\s+free\s+licen[sc]e", ["1.2", "2.1", "3.0"], r"afl", r"opensource\.org/licenses/afl"),
    ("zlib", "zlib", r"zlib(?:/libpng)?\s+licen[sc]e", [], r"zlib", r"zlib\.net/zlib_license"),
    ("isc", "isc", r"isc\s+licen[sc]e", [], r"isc", r"opensource\.org/licenses/isc"),
    ("unlicense", "unlicense", r"the\s+unlicense", [], r"unlicense", r"unlicense\.org"),
    ("wtfpl", "want to public", r"do\s+what\s+the\s+\w+\s+you\s+want\s+to\s+public\s+licen[sc]e", ["1", "2"], r"wtfpl", r"wtfpl\.net"),
    ("ofl", "font", r"(?:sil\s+)?open\s+font\s+licen[sc]e", ["1.0", "1.1"], r"ofl", r"scripts\.sil\.org/ofl"),
    ("ms-pl", "microsoft", r"microsoft\s+public\s+licen[sc]e", [], r"ms-pl", r"opensource\.org/licenses/ms-pl"),
    ("ms-rl", "microsoft", r"microsoft\s+reciprocal\s+licen[sc]e", [], r"ms-rl", r"opensource\.org/licenses/ms-rl"),
    ("psf", "python", r"python\s+software\s+foundation\s+licen[sc]e", ["2.0"], r"psf", r"docs\.python\.org/\S*license"),
    ("php", "php", r"php\s+licen[sc]e", ["3.0", "3.01"], r"php", r"php\.net/license"),
    ("ruby", "ruby", r"ruby(?:'s)?\s+licen[sc]e", [], r"ruby", r"ruby-lang\.org/\S*license"),
    ("openssl", "openssl", r"openssl\s+licen[sc]e", [], r"openssl", r"openssl\.org/source/license"),
    ("postgresql", "postgresql", r"postgresql\s+licen[sc]e", [], r"postgresql", r"postgresql\.org/about/licen[cs]e"),
    ("qpl", "public", r"q\s+public\s+licen[sc]e", ["1.0"], r"qpl", r"opensource\.org/licenses/qpl"),
    ("sleepycat", "sleepycat", r"sleepycat\s+licen[sc]e", [], r"sleepycat", r"opensource\.org/licenses/sleepycat"),
    ("upl", "universal", r"universal\s+permissive\s+licen[sc]e", ["1.0"], r"upl", r"opensource\.org/licenses/upl"),
    ("ncsa", "ncsa", r"(?:university\s+of\s+illinois/)?ncsa\s+open\s+source\s+licen[sc]e", [], r"ncsa", r"opensource\.org/licenses/ncsa"),
    ("vim", "vim", r"vim\s+licen[sc]e", [], r"vim", r"vimhelp\.org/uganda"),
    ("zpl", "zope", r"zope\s+public\s+licen[sc]e", ["1.1", "2.0", "2.1"], r"zpl", r"opensource\.org/licenses/zpl"),
    ("w3c", "w3c", r"w3c\s+software\s+(?:notice\s+and\s+)?licen[sc]e", [], r"w3c", r"w3\.org/consortium/legal"),
    ("odbl", "database", r"open\s+(?:data\s+commons\s+open\s+)?database\s+licen[sc]e", ["1.0"], r"odbl", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by", "attribution", r"open\s+data\s+commons\s+attribution\s+licen[sc]e", ["1.0"], r"odc-by", r"opendatacommons\.org/licenses/by"),
    ("pddl", "public domain", r"public\s+domain\s+dedication\s+and\s+licen[sc]e", ["1.0"], r"pddl", r"opendatacommons\.org/licenses/pddl"),
    ("cecill", "cecill", r"cecill(?:-[bc])?(?:\s+free\s+software)?\s+licen[sc]e", ["1.1", "2.0", "2.1"], r"cecill", r"cecill\.info"),
    ("mulan", "mulan", r"mulan\s+(?:permissive\s+software|public)\s+licen[sc]e", ["1", "2"], r"mulanpsl", r"license\.coscl\.org\.cn"),
    ("rail", "responsible ai", r"(?:open)?(?:\s*&\s*)?responsible\s+ai\s+licen[sc]e", [], r"(?:open)?rail(?:-m)?", r"licenses\.ai"),
    ("llama", "llama", r"llama\s+[\d.]*\s*community\s+licen[sc]e", ["2", "3", "3.1"], r"llama[\d.]*", r"llama\.com/llama\S*license"),
]
CC = ["by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"]
CC_NAMES = {
    "by": r"attribution",
    "by-sa": r"attribution[\s-]+share[\s-]*alike",
    "by-nc": r"attribution[\s-]+non[\s-]*commercial",
    "by-nd": r"attribution[\s-]+no[\s-]*deriv\w*",
    "by-nc-sa": r"attribution[\s-]+non[\s-]*commercial[\s-]+share[\s-]*alike",
    "by-nc-nd": r"attribution[\s-]+non[\s-]*commercial[\s-]+no[\s-]*deriv\w*",
}
#: Sentences that stand for a license without naming it, and notices.
TEXTS = [
    ("mit", "permission is hereby granted", r"permission\s+is\s+hereby\s+granted,?\s+free\s+of\s+charge,?\s+to\s+any\s+person\s+obtaining\s+a\s+copy", 0.95),
    ("mit", "merchantability", r"the\s+software\s+is\s+provided\s+[\"'“”]*as\s+is[\"'“”]*,?\s+without\s+warranty\s+of\s+any\s+kind,?\s+express\s+or\s+implied,?\s+including\s+but\s+not\s+limited\s+to\s+the\s+warranties\s+of\s+merchantability", 0.7),
    ("isc", "with or without fee", r"permission\s+to\s+use,?\s+copy,?\s+modify,?\s+and(?:/or)?\s+distribute\s+this\s+software\s+for\s+any\s+purpose\s+with\s+or\s+without\s+fee", 0.95),
    ("bsd", "redistribution and use", r"redistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms,?\s+with\s+or\s+without\s+modification", 0.9),
    ("bsd-3-clause", "endorse or promote", r"neither\s+the\s+names?\s+of\s+.{1,120}?\s+may\s+be\s+used\s+to\s+endorse\s+or\s+promote", 0.9),
    ("bsd-4-clause", "advertising materials", r"all\s+advertising\s+materials\s+mentioning\s+features\s+or\s+use\s+of\s+this\s+software", 0.9),
    ("apache-2.0", "except in compliance", r"you\s+may\s+not\s+use\s+this\s+file\s+except\s+in\s+compliance\s+with\s+the\s+license", 0.85),
    ("gpl", "free software foundation", r"under\s+the\s+terms\s+of\s+the\s+gnu\s+general\s+public\s+license\s+as\s+published\s+by\s+the\s+free\s+software\s+foundation", 0.98),
    ("lgpl", "free software foundation", r"under\s+the\s+terms\s+of\s+the\s+gnu\s+(?:lesser|library)\s+general\s+public\s+license\s+as\s+published\s+by\s+the\s+free\s+software\s+foundation", 0.98),
    ("mpl-2.0", "mozilla public license", r"subject\s+to\s+the\s+terms\s+of\s+the\s+mozilla\s+public\s+license,?\s+v\.?\s*2\.0", 0.98),
    ("zlib", "misrepresented", r"the\s+origin\s+of\s+this\s+software\s+must\s+not\s+be\s+misrepresented", 0.9),
    ("bsl-1.0", "person or organization obtaining", r"permission\s+is\s+hereby\s+granted,?\s+free\s+of\s+charge,?\s+to\s+any\s+person\s+or\s+organization\s+obtaining\s+a\s+copy", 0.95),
    ("unlicense", "released into the public domain", r"free\s+and\s+unencumbered\s+software\s+released\s+into\s+the\s+public\s+domain", 0.97),
    ("public-domain", "public domain", r"(?:placed|released|dedicated|is)\s+(?:in|into|to)\s+the\s+public\s+domain", 0.7),
    ("all-rights-reserved", "all rights reserved", r"all\s+rights\s+reserved", 0.6),
    ("proprietary", "proprietary", r"proprietary\s+and\s+confidential", 0.7),
    ("proprietary", "unauthori", r"unauthori[sz]ed\s+(?:copying|use|reproduction|distribution)\s+.{0,80}?(?:is\s+)?(?:strictly\s+)?prohibited", 0.7),
]


def _rules() -> list[Rule]:
    """All rules, by falling priority. The families' rows expand into name, version, short-form and address rules."""
    out = []
    for name, key, full, versions, short, url in FAMILIES:
        for v in versions:
            num = v.removesuffix(".0") if v.endswith(".0") else v
            pat = re.escape(num) + (r"(?:\.0)?" if v.endswith(".0") else "") + r"(?![\d]|\.\d)"
            out.append(Rule(f"{name}-{v}-later", f"{name}-{v}-or-later", 95, 0.98, key, full + V + pat + ORLATER))
            out.append(Rule(f"{name}-{v}-name", f"{name}-{v}", 90, 0.97, key, full + V + pat))
            out.append(Rule(f"{name}-{v}-short", f"{name}-{v}", 70, 0.8, _plain(short), rf"(?<![\w-]){short}(?:\s*v\.?\s*|-|\s+(?:version\s+)?){pat}"))
        out.append(Rule(f"{name}-spdx", name, 85, 0.97, "spdx", rf"spdx-license-identifier:\s*{short}(?![a-z])\S*"))
        out.append(Rule(f"{name}-url", name, 80, 0.9, _plain(url), url))
        out.append(Rule(f"{name}-name", name, 60, 0.9, key, rf"(?<!\w){full}(?!\w)"))
        out.append(Rule(f"{name}-under", name, 65, 0.85, _plain(short), rf"licen[sc]ed\s+under\s+(?:the\s+)?{short}(?![\w-])"))
    for kind in CC:
        words = kind.replace("-", r"[\s-]+")
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            out.append(Rule(f"cc-{kind}-{v}", f"cc-{kind}-{v}", 90, 0.95, "cc", rf"(?<!\w)cc[\s-]+{words}[\s-]+{re.escape(v)}(?!\d)"))
        out.append(Rule(f"cc-{kind}", f"cc-{kind}", 60, 0.8, "cc", rf"(?<!\w)cc[\s-]+{words}(?![\w-])"))
        out.append(Rule(f"cc-{kind}-name", f"cc-{kind}", 75, 0.95, "creative commons", rf"creative\s+commons\s+{CC_NAMES[kind]}(?![\s-]+(?:non|share|no[\s-]*deriv))"))
        out.append(Rule(f"cc-{kind}-url", f"cc-{kind}", 80, 0.95, "creativecommons.org", rf"creativecommons\.org/licenses/{kind}/\d\.\d"))
    out.append(Rule("cc0", "cc0-1.0", 80, 0.9, "cc0", r"(?<!\w)cc0(?:[\s-]*1\.0)?(?!\w)"))
    out.append(Rule("cc0-url", "cc0-1.0", 80, 0.95, "creativecommons.org", r"creativecommons\.org/publicdomain/zero/1\.0"))
    for n, word in ((0, "zero"), (2, "two"), (3, "three"), (4, "four")):
        out.append(Rule(f"bsd-{n}", f"bsd-{n}-clause", 85, 0.95, "bsd", rf"(?:bsd[\s-]+{n}[\s-]+clause|(?:{n}|{word})[\s-]+clause\s+bsd)(?:\s+licen[sc]e)?"))
    out.append(Rule("bsd-name", "bsd", 60, 0.85, "bsd", r"(?<!\w)bsd(?:-style)?\s+licen[sc]e"))
    out.append(Rule("bsd-under", "bsd", 65, 0.8, "bsd", r"licen[sc]ed\s+under\s+(?:the\s+)?bsd(?!\w)"))
    out += [Rule(f"text-{i}", label, 100, conf, key, rx) for i, (label, key, rx, conf) in enumerate(TEXTS)]
    return sorted(out, key=lambda r: (-r.priority, -len(r.regex), r.name))


def _plain(pattern: str) -> str:
    """The longest literal that any match of a short pattern holds."""
    literal = re.sub(r"\(\?:[^()]*\)\??|\[[^\]]*\][*+?]?|\\S\*?|\\[dws][*+?]?", "\0", pattern).replace("\\", "")
    return max(literal.split("\0"), key=len)


RULES = _rules()


class Scanner:
    """Compiled rules behind one keyword pass. ``scan`` works on whole texts of any length."""

    def __init__(self, rules: list[Rule] = RULES):
        self.rules = [(r, re.compile(r.regex)) for r in rules]
        self.by_key = defaultdict(list)
        for i, r in enumerate(rules):
            self.by_key[r.keyword].append(i)

    def scan(self, low: str) -> list[tuple[str, str, int, int, float]]:
        """(label, rule, start, end, confidence) of the kept detections of a lower-cased text, in order of place."""
        plain = " ".join(low.split())  # keywords of several words may stand across a line break
        wanted = sorted(i for key, at in self.by_key.items() if key in plain for i in at)
        kept: list[tuple[int, int, Rule]] = []
        # Kept intervals that lie in no other one: starts rise, and so do ends.
        starts: list[int] = []
        ends: list[int] = []
        for i in wanted:
            rule, rx = self.rules[i]
            for m in rx.finditer(low):
                a, b = m.span()
                at = bisect.bisect_right(starts, a)
                if at and ends[at - 1] >= b:
                    continue
                kept.append((a, b, rule))
                lo = bisect.bisect_left(starts, a)
                hi = bisect.bisect_right(ends, b)
                starts[lo:hi], ends[lo:hi] = [a], [b]
        return sorted((r.label, r.name, a, b, r.confidence) for a, b, r in kept)


def ascii_lower(text: str) -> str:
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


_PHRASES = [(p.split(), label) for p, label in BASE]
#: No base phrase without one of these.
_NEEDED = re.compile(r"license|cc[\x00-\x2F\x3A-\x60\x7B-\x7F]+by")


def base_places(words: list[str]) -> list[tuple[int, str]]:
    """(start, label) of every place where a base phrase's words stand consecutively."""
    out = []
    for phrase, label in _PHRASES:
        at = -1
        try:
            while True:
                at = words.index(phrase[0], at + 1)
                if words[at : at + len(phrase)] == phrase:
                    out.append((at, label))
        except ValueError:
            pass
    return out


def scan_licenses(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Scan every whole text: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    Null texts count as empty: no words, no places, empty label lists, score 0. Null ids stay null,
    repeated rows stay repeated, other columns are ignored. Score: 1 - product of (1 - confidence)
    over the distinct labels found (0.9 for a base label), 0 without any.
    """

    def run(batches):
        scanner = Scanner(rules)
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist()):
                low = ascii_lower(text)
                words = WORDS.findall(low)
                n = len(words)
                base = base_places(words) if _NEEDED.search(low) else []
                found = scanner.scan(low)
                conf: dict[str, float] = {}
                for label, _, _, _, c in found:
                    conf[label] = max(c, conf.get(label, 0.0))
                for _, label in base:
                    conf[label] = max(0.9, conf.get(label, 0.0))
                miss = 1.0
                for label in sorted(conf):
                    miss *= 1 - conf[label]
                starts = [at for at, _ in base]
                rows.append((doc_id, n, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(conf)), 1 - miss if conf else 0.0, [dict(zip(("label", "rule", "start", "end", "confidence"), x)) for x in found]))
            out = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"])
            out["first_word"] = out["first_word"].astype("Int64")
            out["last_word"] = out["last_word"].astype("Int64")
            yield out

    # Ids go as text: pandas would turn a nullable long into a double.
    slim = common.in_small_batches(docs).select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return slim.mapInPandas(common.releasing(run), OUT).withColumn("doc_id", F.col("doc_id").cast("long"))
