"""License scan by ordered signature rules, in DataFrame functions only.

A rule is a pair of regexes over lowered words joined by single spaces: one for what precedes its keyword, one for what
begins at it. ``rules()`` builds some hundreds from the hand-written names of license families and the ways in which
texts cite a license; a name that is also a plain word, such as the German "mit", needs such a citation. Keywords are the prefilter: a text without any runs no rule, and at a keyword's place only its own
rules run, on the few words around it. Overlaps are resolved by priority and containment: a detection goes if another
of higher priority, or of the same and longer, covers its interval.

The base phrases are found apart, as consecutive words, and their labels always stay. ``score`` is the greatest
confidence of what is left: 1 with a base phrase, 0 with nothing.

Null and empty texts have no words. Every row gives one row; nothing is shuffled. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# How families name themselves. Label, keyword, the name from the keyword on, SPDX names.
VERSION = "(?: version| v)?"
FAMILIES = (
    ("mit", "mit", "mit", "mit"),
    ("mit-0", "mit", "mit (?:0|no attribution)", "mit 0"),
    ("apache-1.1", "apache", f"apache(?: software)?(?: license)?{VERSION} 1 1", "apache 1 1"),
    ("apache-2", "apache", f"apache(?: software)?(?: license)?{VERSION} 2(?: 0)?", "apache 2 0"),
    ("bsd-2-clause", "bsd", "bsd (?:2 clause|simplified)", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", "bsd (?:3 clause|new|revised)", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", "bsd (?:4 clause|original)", "bsd 4 clause"),
    ("0bsd", "0bsd", "0bsd", "0bsd"),
    ("isc", "isc", "isc", "isc"),
    ("gpl-1", "gnu", f"gnu general public license{VERSION} 1(?: 0)?", "gpl 1 0(?: only| or later)?"),
    ("gpl-2", "gnu", f"gnu general public license{VERSION} 2(?: 0)?", "gpl 2 0(?: only| or later)?"),
    ("gpl-3", "gnu", f"gnu general public license{VERSION} 3(?: 0)?", "gpl 3 0(?: only| or later)?"),
    ("gpl-2", "gpl", f"gpl{VERSION} ?2(?: 0)?", "gpl 2 0"),
    ("gpl-2", "gplv2", "gplv2", "gplv2"),
    ("gpl-3", "gpl", f"gpl{VERSION} ?3(?: 0)?", "gpl 3 0"),
    ("gpl-3", "gplv3", "gplv3", "gplv3"),
    ("lgpl-2", "gnu", f"gnu library general public license{VERSION} 2(?: 0)?", "lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "gnu", f"gnu lesser general public license{VERSION} 2 1", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-3", "gnu", f"gnu lesser general public license{VERSION} 3(?: 0)?", "lgpl 3 0(?: only| or later)?"),
    ("lgpl-3", "lgpl", f"lgpl{VERSION} ?3(?: 0)?", "lgpl 3 0"),
    ("agpl-3", "gnu", f"gnu affero general public license{VERSION} 3(?: 0)?", "agpl 3 0(?: only| or later)?"),
    ("agpl-3", "agpl", f"agpl{VERSION} ?3(?: 0)?", "agpl 3 0"),
    ("gfdl", "gnu", "gnu free documentation license", "gfdl 1 [123]"),
    ("mpl-1.1", "mozilla", f"mozilla public license{VERSION} 1 1", "mpl 1 1"),
    ("mpl-2", "mozilla", f"mozilla public license{VERSION} 2(?: 0)?", "mpl 2 0"),
    ("mpl-2", "mpl", f"mpl{VERSION} ?2(?: 0)?", "mpl 2 0"),
    ("epl-1", "eclipse", f"eclipse public license{VERSION} 1(?: 0)?", "epl 1 0"),
    ("epl-2", "eclipse", f"eclipse public license{VERSION} 2(?: 0)?", "epl 2 0"),
    ("cddl-1", "common", f"common development and distribution license{VERSION}(?: 1(?: [01])?)?", "cddl 1 [01]"),
    ("cpl-1", "common", f"common public license{VERSION}(?: 1(?: 0)?)?", "cpl 1 0"),
    ("artistic-1", "artistic", f"artistic license{VERSION} 1(?: 0)?", "artistic 1 0"),
    ("artistic-2", "artistic", f"artistic license{VERSION} 2(?: 0)?", "artistic 2 0"),
    ("boost-1", "boost", f"boost software license{VERSION}(?: 1(?: 0)?)?", "bsl 1 0"),
    ("zlib", "zlib", "zlib(?: libpng)?", "zlib"),
    ("unlicense", "unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl", "wtfpl"),
    ("eupl-1.2", "european", f"european union public licen[sc]e{VERSION}(?: 1 2)?", "eupl 1 2"),
    ("ofl-1.1", "sil", f"sil open font license{VERSION}(?: 1 1)?", "ofl 1 1"),
    ("postgresql", "postgresql", "postgresql licen[sc]e", "postgresql"),
    ("python-2", "python", f"python software foundation license{VERSION}(?: 2)?", "psf 2 0"),
    ("ncsa", "ncsa", "ncsa(?: open source)?", "ncsa"),
    ("cc0", "cc0", "cc0(?: 1 0)?", "cc0 1 0"),
    ("cc-by", "cc", "cc by(?: [1234] [05])?(?! (?:nc|nd|sa))", "cc by [1234] [05]"),
    ("cc-by-sa", "cc", "cc by sa(?: [1234] [05])?", "cc by sa [1234] [05]"),
    ("cc-by-nd", "cc", "cc by nd(?: [1234] [05])?", "cc by nd [1234] [05]"),
    ("cc-by-nc", "cc", "cc by nc(?: [1234] [05])?(?! (?:nd|sa))", "cc by nc [1234] [05]"),
    ("cc-by-nc-sa", "cc", "cc by nc sa(?: [1234] [05])?", "cc by nc sa [1234] [05]"),
    ("cc-by-nc-nd", "cc", "cc by nc nd(?: [1234] [05])?", "cc by nc nd [1234] [05]"),
    ("cc-by", "creative", "creative commons attribution(?: [1234] [05])?(?! (?:non|share|no))", "cc by [1234] [05]"),
    ("cc-by-sa", "creative", "creative commons attribution share ?alike(?: [1234] [05])?", "cc by sa [1234] [05]"),
    ("cc-by-nd", "creative", "creative commons attribution no ?deriv\\w*(?: [1234] [05])?", "cc by nd [1234] [05]"),
    ("cc-by-nc", "creative", "creative commons attribution non ?commercial(?: [1234] [05])?", "cc by nc [1234] [05]"),
)

# Ways to cite. Before the name, after it, priority, confidence.
GRANT = "(?:licensed|released|distributed|available|published|provided|redistributed|covered)"
CITATIONS = (
    (f"{GRANT} under (?:the |a )?(?:terms of (?:the )?)?$", "(?: licen[sc]e)?(?: |$)", 4, 1.0),
    ("(?:terms|conditions|text) of the $", "(?: licen[sc]e)?(?: |$)", 3, 0.9),
    ("(?:licen[sc]es?|licensed|licensing) (?:is |as |type )?$", "(?: |$)", 3, 0.8),
    ("", " licen[sc]e(?: |$)", 2, 0.8),
    ("", "(?: |$)", 1, 0.5),
)
#: Keyword and label of names that are also words of a language or places; alone they are no detection.
WORDS_TOO = (("mit", "mit"), ("mit", "mit-0"), ("isc", "isc"), ("cc", "cc-by"))
#: Words before a keyword, and from it on, that a rule may look at.
LEFT, RIGHT = 10, 16


def rules() -> list[tuple[int, str, str, str, str, int, float]]:
    """Number, keyword, before, after, label, priority, confidence."""
    out = []
    for label, keyword, name, spdx in FAMILIES:
        name = name.replace(VERSION + " ", VERSION + "(?: | v)")  # "version 3", "v 3", "v3"
        ways = CITATIONS[:-1] if (keyword, label) in WORDS_TOO else CITATIONS
        out += [(keyword, b, f"^(?:{name}){a}", label, p, c) for b, a, p, c in ways]
        out.append(("spdx", "", f"^spdx licen[sc]e identifier (?:{spdx})(?: |$)", label, 5, 1.0))
    return [(i, *rule) for i, rule in enumerate(out)]


def _rule_map(table: list) -> Column:
    by: dict[str, list] = {}
    for i, keyword, before, after, label, priority, confidence in table:
        fields = (("rule", i), ("before", f"(?:^| ){before}" if before else "$"), ("after", after), ("label", label), ("priority", priority), ("confidence", confidence))
        by.setdefault(keyword, []).append(F.struct(*[F.lit(v).alias(k) for k, v in fields]))
    return F.create_map(*[c for k, v in by.items() for c in (F.lit(k), F.array(*v))])


def _count(words: Column) -> Column:
    """Words in a string joined by single spaces, which may end in one."""
    bare = F.trim(F.coalesce(words, F.lit("")))  # an empty match is null
    return F.when(bare == "", 0).otherwise(F.length(bare) - F.length(F.replace(bare, F.lit(" "), F.lit(""))) + 1)


def _places(words: Column, phrase: list[str]) -> Column:
    """Where the phrase's words stand consecutively, from 0."""
    last = F.size(words) - len(phrase)

    def here(i: Column) -> Column:
        out = F.get(words, i) == phrase[0]
        for k, w in enumerate(phrase[1:], 1):
            out = out & (F.get(words, i + k) == w)
        return out

    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), here)).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, base: tuple[tuple[str, str], ...] = BASE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and ``detections``: what the rules
    left, as (rule, label, start, stop, priority, confidence) in order of place."""
    table = rules()
    keywords = sorted({r[1] for r in table})
    widest = max(sum(r[1] == k for r in table) for k in keywords)
    gate = "(?i)(?:^| )(?:" + "|".join(sorted({*keywords, *[p.split(" ")[0] for p, _ in base]})) + ")(?: |$)"
    none = F.array().cast("array<struct<rule:int,label:string,start:int,stop:int,priority:int,confidence:double>>")

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    joined = F.trim(F.regexp_replace("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "))
    df = df.select("doc_id", joined.alias("joined"))
    capitals = "".join(map(chr, range(0x41, 0x5B)))
    lowered = F.translate("joined", capitals, capitals.lower())
    words = F.when(F.col("joined").rlike(gate), F.split(lowered, " ")).otherwise(F.array().cast("array<string>"))
    df = df.select("doc_id", _count(F.col("joined")).cast("long").alias("n_words"), words.alias("words"))
    found = [(label, _places(F.col("words"), phrase.split(" "))) for phrase, label in base]
    df = df.select("*", *[p.alias(f"p{i}") for i, (_, p) in enumerate(found)])
    places = F.concat(*[F.col(f"p{i}") for i in range(len(base))])

    def around(i: Column) -> Column:
        left = F.array_join(F.slice("words", F.greatest(F.lit(1), i + 1 - LEFT), F.least(i, F.lit(LEFT))), " ")
        return F.struct(
            i.alias("at"),
            F.concat(left, F.lit(" ")).alias("left"),
            F.array_join(F.slice("words", i + 1, RIGHT), " ").alias("right"),
            F.get("words", i).alias("word"),
        )

    hits = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i).isin(keywords))
    hits = F.when(F.size("words") > 0, F.transform(hits, around))
    df = df.withColumn("hits", hits).withColumn("places", places)
    ruled = _rule_map(table)

    def detect(h: Column) -> Column:
        own = F.filter(F.element_at(ruled, h["word"]), lambda r: F.rlike(h["right"], r["after"]) & F.rlike(h["left"], r["before"]))
        return F.transform(
            own,
            lambda r: F.struct(
                r["rule"].alias("rule"),
                r["label"].alias("label"),
                (h["at"] - _count(F.regexp_substr(h["left"], r["before"]))).cast("int").alias("start"),
                (h["at"] + _count(F.regexp_substr(h["right"], r["after"]))).cast("int").alias("stop"),
                r["priority"].alias("priority"),
                r["confidence"].alias("confidence"),
            ),
        )

    raw = F.coalesce(F.flatten(F.transform("hits", detect)), none)
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["rule"] - b["rule"])
    df = df.withColumn("raw", F.array_sort(raw, order))
    # an interval that covers another begins at most LEFT + RIGHT words before it, and a word has few rules
    reach = (LEFT + RIGHT) * widest

    def stays(d: Column, i: Column) -> Column:
        near = F.slice("raw", F.greatest(F.lit(1), i + 1 - reach), F.lit(2 * reach + 1))
        longer = lambda e: e["stop"] - e["start"] > d["stop"] - d["start"]
        same = lambda e: (e["stop"] - e["start"] == d["stop"] - d["start"]) & (e["rule"] < d["rule"])
        above = lambda e: (e["priority"] > d["priority"]) | ((e["priority"] == d["priority"]) & (longer(e) | same(e)))
        return ~F.exists(near, lambda e: (e["start"] <= d["start"]) & (e["stop"] >= d["stop"]) & above(e))

    df = df.withColumn("detections", F.filter("raw", stays))
    base_labels = F.filter(
        F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(base)]), lambda x: x.isNotNull()
    )
    df = df.withColumn("own", F.array_sort(F.array_distinct(base_labels)))
    every = F.array_sort(F.array_distinct(F.concat("own", F.transform("detections", lambda d: d["label"]))))
    best = F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0))
    return df.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join("own", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(best).alias("score"),
        "detections",
    )
