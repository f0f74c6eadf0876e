"""Endpoints bound to their values inside a sentence, literally or not at all.

What follows an endpoint up to the next one is matched by one grammar of atomic parts: a connector, perhaps a
count with its percentage, one or two parallel values. Which parts are there decides between a binding and the
reason for an abstention. As a grammar with positions is beyond column functions, this runs in Python over Arrow
batches, a sentence at a time.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

METHOD = "literal_bindings_v1"
# Number, units, endpoints, connectors, arms and their exceptions must be these for the same results.
N = r"\d+(?:\.\d+)?"
UNITS = r"%|％|个月|天|周|年"
INTERVAL = rf"95%\s*(?:CI|置信区间)\s*[:：]?\s*(?:{N}|NA|NR)\s*[-–~]\s*(?:{N}|NA|NR)"
BOUNDS = re.compile(rf"95%\s*(?:CI|置信区间)\s*[:：]?\s*({N}|NA|NR)\s*[-–~]\s*({N}|NA|NR)", re.I)
CONNECTOR = r"\s*(?:[（(][A-Za-z ,\-]+[)）]\s*)?(?:(?:分别)?(?:为|达到|达)|发生率(?:为|达到)|[（(])\s*"
PAIR = r"\s*(?:和|与|vs\.?|versus)\s*"
ENDPOINT = re.compile(
    r"(?P<median>中位)?(?P<name>总生存期|无进展生存期|客观缓解率|缓解率|(?<![A-Za-z])(?:OS|PFS|ORR)(?![A-Za-z])|"
    r"(?:≥\s*3级|3[-–]4级|任意等级|总体)?(?:治疗相关)?(?:不良事件|不良反应|TRAEs?|TEAEs?|AEs?)(?:发生率)?)", re.I
)
NAMES = {"OS": "OS", "总生存期": "OS", "PFS": "PFS", "无进展生存期": "PFS", "ORR": "ORR", "客观缓解率": "ORR", "缓解率": "ORR"}
SURVIVAL, OUTCOMES = {"OS", "PFS"}, {"OS", "PFS", "ORR"}
EXPANSION = re.compile(r"[（(][A-Za-z ,\-]+[)）]")
ARM = re.compile(r"[一-鿿A-Za-z0-9-]{1,24}?组")
ARM_LEAD = re.compile(r"(?:而|其中|在|结果显示|研究发现|发现|匹配前|匹配后|接受)*[和与及]*")
NO_ARMS = {"两组", "二组", "各组", "亚组", "分组"}
CLAUSE = re.compile(r"[，,；;。]")


def _value(k: int) -> str:
    return rf"(?P<v{k}>{N})(?:\s*[（(]\s*(?P<ci{k}>{INTERVAL})\s*[)）])?\s*(?P<u{k}>{UNITS})?"


def _tail(counted: bool) -> re.Pattern:
    """Each part is atomic: once matched it isn't tried shorter, so a missing part shows as a missing group."""
    count = rf"(?>(?:(?P<n>{N})\s*例\s*[（(]\s*(?={N}\s*[%％]\s*[)）]))?)" if counted else "(?P<n>(?!))?"
    return re.compile(rf"(?>(?P<link>{CONNECTOR}))(?:{count}(?>{_value(1)})(?:(?>{PAIR})(?>{_value(2)})(?P<more>{PAIR})?)?)?", re.I)


TAILS = {True: _tail(True), False: _tail(False)}
SPAN = "struct<text:string,start:int,end:int>"
BINDING = (
    f"struct<endpoint:string,statistic:string,endpoint_reference:{SPAN},value:double,unit:string,value_reference:{SPAN},unit_inherited:boolean,arm:{SPAN},arm_binding:string,"
    f"parallel_position:int,interval:struct<lower:double,upper:double>,count:double,count_reference:{SPAN},method:string,status:string>"
)
RESULT = f"struct<bindings:array<{BINDING}>,abstentions:array<struct<reason:string,endpoint:{SPAN}>>>"


class Sentence:
    """Suggestions for one sentence that starts at ``base`` of its document."""

    def __init__(self, text: str, base: int):
        self.text, self.base = text, base
        self.clauses = [0, *(m.end() for m in CLAUSE.finditer(text))]  # where each begins

    def ref(self, start: int, end: int) -> dict:
        return {"text": self.text[start:end], "start": self.base + start, "end": self.base + end}

    def endpoints(self) -> list[re.Match]:
        """Those of the text in which expansions in parentheses are blank."""
        return list(ENDPOINT.finditer(EXPANSION.sub(lambda m: f"{m.group()[0]}{' ' * (len(m.group()) - 2)}{m.group()[-1]}", self.text)))

    def arms(self, before: int) -> list[dict]:
        """Arms named in the clause that leads to a position, without the words that lead to their names."""
        clause = self.clauses[bisect_right(self.clauses, before) - 1]
        named = ((m, ARM_LEAD.match(m.group()).end()) for m in ARM.finditer(self.text, clause, before))
        return [self.ref(m.start() + lead, m.end()) for m, lead in named if m.group()[lead:] not in NO_ARMS]

    @staticmethod
    def refusal(name: str, tail: re.Match | None) -> str | None:
        """The first reason that stands against a binding."""
        if tail is None:
            return "no_explicit_value_connector"
        if tail["v1"] is None:
            return "non_numeric_or_unreached_endpoint"
        units = [tail["u1"]] if tail["v2"] is None else [tail["u1"], tail["u2"]]
        if not units[-1] or len({u for u in units if u}) > 1:
            return "missing_or_mixed_units"
        if (units[-1] in "%％") == (name in SURVIVAL):
            return "endpoint_unit_mismatch"
        return "more_than_two_parallel_values" if tail["more"] is not None else None

    def bind(self, endpoint: re.Match, name: str, tail: re.Match) -> list[dict]:
        places = [1] if tail["v2"] is None else [1, 2]
        unit, arms = tail[f"u{places[-1]}"], self.arms(endpoint.start())
        told = len(arms) == len(places) and (len(places) == 1 or "分别" in tail["link"])
        if told and len(places) == 2:  # the two arms are named side by side
            told = self.text[arms[0]["end"] - self.base : arms[1]["start"] - self.base].strip() in ("和", "与", "及")
        out = []
        for k in places:
            bounds = BOUNDS.fullmatch(tail[f"ci{k}"]) if tail[f"ci{k}"] else None
            ends = [None if b.upper() in ("NA", "NR") else float(b) for b in bounds.groups()] if bounds else None
            out.append({
                "endpoint": name, "statistic": "median" if endpoint["median"] else "reported", "endpoint_reference": self.ref(*endpoint.span()),
                "value": float(tail[f"v{k}"]), "unit": "%" if unit == "％" else unit, "value_reference": self.ref(tail.start(f"v{k}"), self.value_end(tail, k)),
                "unit_inherited": tail[f"u{k}"] is None, "arm": arms[k - 1] if told else None, "arm_binding": "explicit_same_clause" if told else "unassigned",
                "parallel_position": k - 1 if len(places) == 2 else None, "interval": dict(zip(("lower", "upper"), ends)) if ends else None,
                "count": float(tail["n"]) if tail["n"] else None, "count_reference": self.ref(*tail.span("n")) if tail["n"] else None, "method": METHOD, "status": "pending",
            })
        return out

    @staticmethod
    def value_end(tail: re.Match, k: int) -> int:
        """A value ends with its unit, else with its interval's bracket and the white space that follows, as far as matched."""
        if tail[f"u{k}"] is not None:
            return tail.end(f"u{k}")
        return re.compile(rf"{N}(?:\s*[（(]\s*{INTERVAL}\s*[)）])?\s*", re.I).match(tail.string, tail.start(f"v{k}"), tail.endpos).end()

    def suggest(self, kind: str | None) -> dict:
        endpoints = self.endpoints()
        if kind == "table_row":  # cells have headers that a row doesn't show
            return {"bindings": [], "abstentions": [{"reason": "table_headers_not_bound", "endpoint": None}] if endpoints else []}
        bindings, abstentions = [], []
        stops = [*(m.start() for m in endpoints), len(self.text)]
        for endpoint, (_, stop) in zip(endpoints, pairwise(stops)):
            raw = endpoint["name"]
            name = NAMES.get(raw.upper(), raw)
            tail = TAILS[name not in OUTCOMES].match(self.text, endpoint.end(), stop)
            reason = self.refusal(name, tail)
            if reason:
                abstentions.append({"reason": reason, "endpoint": self.ref(*endpoint.span())})
            else:
                bindings += self.bind(endpoint, name, tail)
        return {"bindings": bindings, "abstentions": abstentions}


def _suggest(text: pd.Series, base: pd.Series, kind: pd.Series) -> pd.DataFrame:
    found = [Sentence(t or "", int(b)).suggest(k) for t, b, k in zip(text, base, kind)]
    return pd.DataFrame({"bindings": [f["bindings"] for f in found], "abstentions": [f["abstentions"] for f in found]})


def suggestions(text: Column, base: Column, kind: Column) -> Column:
    """struct<bindings, abstentions> of a sentence."""
    return pandas_udf(_suggest, RESULT)(text, base, kind)
