"""Similarity coefficients over contingency counts, as SQL expressions that Spark compiles.

ef, nf: failing runs that did and didn't hit; ep, np: passing ones. f = ef + nf, p = ep + np. All are doubles, so
products of four counts don't overflow. A zero denominator makes the whole score 0.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _over(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


_CROSS = "2 * ef * np - 2 * nf * ep"
_SQUARE = "4 * ef * np - 4 * nf * ep - (nf - ep) * (nf - ep)"
_EXPECTED = {"ef": "(ef + ep) * f", "ep": "(ef + ep) * p", "nf": "(nf + np) * f", "np": "(nf + np) * p"}


def _chi(observed: str, cell: str) -> str:
    expected = _over(_EXPECTED[cell], "f + p")
    return _over(f"({observed} - {expected}) * ({observed} - {expected})", expected)


#: Name to expression. Naming and terms are those of the fault localization literature.
FORMULAS: dict[str, str] = {
    "AMPLE": f"abs({_over('ef', 'f')} - {_over('ep', 'p')})",
    "AMPLE2": f"{_over('ef', 'f')} - {_over('ep', 'p')}",
    "Anderberg": _over("ef", "ef + 2 * (nf + ep)"),
    "ArithmeticMean": _over(_CROSS, "(ef + ep) * (nf + np) * f * p"),
    "Binary": "case when ef < f then 0.0 else 1.0 end",
    "CBIInc": f"{_over('ef', 'ef + ep')} - {_over('f', 'f + p')}",
    "Cohen": _over(_CROSS, "(ef + ep) * p + f * (nf + np)"),
    # The first observed count is nf, as in the definition that results must equal.
    "Crosstab": " + ".join(_chi(*c) for c in (("nf", "ef"), ("ep", "ep"), ("nf", "nf"), ("np", "np"))),
    "Dice": _over("2 * ef", "f + ep"),
    "DStar": _over("ef * ef", "nf + ep"),
    "Euclid": "sqrt(ef + np)",
    "Fleiss": _over(_SQUARE, "(2 * ef + nf + ep) + (2 * np + nf + ep)"),
    "GP02": "2 * (ef + sqrt(np)) + sqrt(ep)",
    "GP03": "sqrt(abs(ef * ef - sqrt(ep)))",
    "GP13": f"ef * (1 + {_over('1', '2 * ep + ef')})",
    "GP19": "ef * sqrt(abs(ep - ef + nf - np))",
    "Goodman": _over("2 * ef - nf - ep", "2 * ef + nf + ep"),
    "Hamann": _over("ef + np - nf - ep", "f + p"),
    "HammingEtc": "ef + np",
    "HarmonicMean": _over("(ef * np - nf * ep) * ((ef + ep) * (nf + np) + f * p)", "(ef + ep) * (nf + np) * f * p"),
    "Jaccard": _over("ef", "f + ep"),
    "Kulczynski1": _over("ef", "nf + ep"),
    "Kulczynski2": f"0.5 * ({_over('ef', 'f')} + {_over('ef', 'ef + ep')})",
    "M1": _over("ef + np", "nf + ep"),
    "M2": _over("ef", "ef + np + 2 * (nf + ep)"),
    "Naish1": "case when ef < f then -1.0 else np end",
    "Naish2": f"ef - {_over('ep', 'p + 1')}",
    "Ochiai": _over("ef", "sqrt(f * (ef + ep))"),
    "Ochiai2": _over("ef * np", "sqrt((ef + ep) * (nf + np) * f * p)"),
    "PairScoring": "ef * (2 * np + ep)",
    "qe": _over("ef", "ef + ep"),
    "RogersAndTanimoto": _over("ef + np", "ef + np + 2 * (nf + ep)"),
    "Rogot1": f"0.5 * ({_over('ef', '2 * ef + nf + ep')} + {_over('np', '2 * np + nf + ep')})",
    "Rogot2": f"0.25 * ({_over('ef', 'ef + ep')} + {_over('ef', 'f')} + {_over('np', 'p')} + {_over('np', 'nf + np')})",
    "RusselAndRao": _over("ef", "f + p"),
    "Scott": _over(_SQUARE, "(2 * ef + nf + ep) * (2 * np + nf + ep)"),
    "SimpleMatching": _over("ef + np", "f + p"),
    "Sokal": _over("2 * (ef + np)", "2 * (ef + np) + nf + ep"),
    "SorensenDice": _over("2 * ef", "2 * ef + nf + ep"),
    "Tarantula": _over(_over("ef", "f"), f"{_over('ef', 'f')} + {_over('ep', 'p')}"),
    "Wong1": "ef",
    "Wong2": "ef - ep",
    "Wong3": "ef - case when ep <= 2 then ep when ep <= 10 then 2 + 0.1 * (ep - 2) else 2.8 + 0.001 * (ep - 10) end",
    "Zoltar": _over("ef", f"f + ep + {_over('10000 * nf * ep', 'ef')}"),
}

#: Scores of predicates only, from the counts of runs that observed them.
PREDICATE_FORMULAS = {
    "FailTrue": f"coalesce({_over('tr', 'tr + ti')}, 0)",
    "FailFalse": f"coalesce({_over('fr', 'fr + fi')}, 0)",
    "Contex": f"coalesce({_over('tr + fr', 'tr + ti + fr + fi')}, 1)",
}
PREDICATE_FORMULAS["IncreaseTrue"] = f"{PREDICATE_FORMULAS['FailTrue']} - {PREDICATE_FORMULAS['Contex']}"
PREDICATE_FORMULAS["IncreaseFalse"] = f"{PREDICATE_FORMULAS['FailFalse']} - {PREDICATE_FORMULAS['Contex']}"

DIGITS = 9


def expression(name: str) -> str:
    """The score's SQL over double columns ef, nf, ep, np, f, p (tr, ti, fr, fi for predicates' own scores)."""
    body = FORMULAS.get(name) or PREDICATE_FORMULAS.get(name)
    if body is None:
        raise ValueError(f"there is no metric {name}")
    return f"round(coalesce({body}, 0), {DIGITS})"


def metric(name: str) -> Column:
    return F.expr(expression(name))


def register(spark: SparkSession) -> None:
    """Makes every coefficient a SQL function similarity_<name>(ep, np, ef, nf) of the session."""
    for name in FORMULAS:
        text = re.sub(r"\bp\b", "(ep + np)", re.sub(r"\bf\b", "(ef + nf)", expression(name)))
        spark.sql(f"create or replace temporary function similarity_{name.lower()}(ep double, np double, ef double, nf double) returns double return {text}")


def similarity(name: str, po: Column, pn: Column, fo: Column, fn: Column) -> Column:
    """A coefficient of any four counts: passing runs that did and didn't hit, then failing ones. After register()."""
    return F.call_function(f"similarity_{name.lower()}", *(c.cast("double") for c in (po, pn, fo, fn)))
