"""Package states as a resolver trace writes them: ``< current -> candidate @status flags >``.

Decoded with higher-order functions only.  A state is
struct<raw, cur_version, cand_version, selection, mode, status, bits, unknown_tokens>.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

STATE = r"<\s*((?:->|[^<>])*?)\s*>"
NONE, SELECTED, DECLINED = 0, 1, 2
#: Action letters, markers of brokenness and their bits, and dpkg's status letters.
MODES = {"K": 1, "U": 2, "N": 3, "R": 4, "P": 5, "H": 6}
BROKEN = {"Ib": 0, "Nb": 1, "IPb": 2, "NPb": 3}
FROM_USER, AUTO_INSTALLED, THIRD_PARTY, REINSTATED = 4, 5, 6, 7
STATUS = {"i": "installed", "w": "installed", "t": "installed", "n": "not_installed", "c": "not_installed", "u": "half_configured", "f": "half_configured", "h": "half_configured"}


def _lookup(table: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def skeleton(line: Column) -> Column:
    """The line without its states, blanks collapsed."""
    # most lines hold neither a state nor blanks to collapse; both are told without a replacement
    bare = F.when(line.contains("<"), F.regexp_replace(line, STATE, " ")).otherwise(line)
    return T.bound(bare, lambda x: F.trim(F.when(x.rlike(r"\s\s|[^\S ]"), F.regexp_replace(x, r"\s+", " ")).otherwise(x)))


def state_bodies(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(STATE), F.lit(1))


def _version(text: Column) -> Column:
    return F.nullif(F.nullif(F.trim(text), F.lit("")), F.lit("none"))


def _after(text: Column, mark: str) -> Column:
    """What follows the first ``mark``; empty where there is none."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substring(text, at + len(mark), F.length(text))).otherwise("")


def decode(body: Column) -> Column:
    """One state from the text between its brackets.

    What is named more than once is bound, since nothing in a lambda is shared otherwise.
    """
    is_mode = lambda t: t.rlike("^[umgp]*[KUNRPH]$")
    parts = F.struct(F.trim(F.substring_index(body, "@", 1)).alias("versions"), F.trim(_after(body, "@")).alias("flags"))

    def of_tokens(versions: Column, flags: Column, tokens: Column, status: Column) -> Column:
        rest = F.filter(tokens, lambda t, i: (i > 0) | status.isNull())
        kinds = F.transform(rest, lambda t: F.struct(t.alias("t"), F.when(t.isin(*BROKEN), 1).when(is_mode(t), 2).otherwise(0).alias("kind")))
        return T.bound(kinds, lambda k: of_kinds(versions, flags, status, k))

    def of_kinds(versions: Column, flags: Column, status: Column, kinds: Column) -> Column:
        is_group = lambda k: k["kind"] == 2
        bits = F.aggregate(kinds, F.lit(0), lambda n, k: F.when(k["kind"] == 1, n.bitwiseOR(_lookup({m: 1 << b for m, b in BROKEN.items()})[k["t"]])).when(is_group(k) & k["t"].contains("g"), n.bitwiseOR(F.lit(1 << AUTO_INSTALLED))).otherwise(n))
        mode = F.aggregate(kinds, F.lit(0), lambda n, k: F.when(is_group(k), F.coalesce(_lookup(MODES)[F.substring(k["t"], -1, 1)], F.lit(0))).otherwise(n))
        arrow, bar = versions.contains("->"), versions.contains("|")
        left = F.when(arrow, F.substring_index(versions, "->", 1)).when(bar, F.substring_index(versions, "|", 1)).otherwise(versions)
        right = F.when(arrow, _after(versions, "->")).when(bar, _after(versions, "|"))
        return F.struct(
            F.when(flags == "", "").otherwise(F.concat(F.lit("@"), flags)).alias("raw"),
            _version(left).alias("cur_version"),
            _version(right).alias("cand_version"),
            F.when(arrow, SELECTED).when(bar, DECLINED).otherwise(NONE).alias("selection"),
            mode.alias("mode"),
            F.coalesce(status, F.lit("unknown")).alias("status"),
            bits.alias("bits"),
            F.transform(F.filter(kinds, lambda k: k["kind"] == 0), lambda k: k["t"]).alias("unknown_tokens"),
        )

    def of_flags(p: Column) -> Column:
        tokens = F.filter(F.split(p["flags"], r"\s+"), lambda t: t != "")
        first = lambda t: F.coalesce(F.get(t, F.lit(0)), F.lit(""))
        told = lambda t: F.struct(t.alias("tokens"), F.when(first(t).rlike("^[ihrpu][incufhwt]$"), _lookup(STATUS)[F.substring(first(t), 2, 1)]).alias("status"))
        return T.bound(T.bound(tokens, told), lambda x: of_tokens(p["versions"], p["flags"], x["tokens"], x["status"]))

    return T.bound(parts, of_flags)


def states(line: Column) -> Column:
    """Every state of a line, left to right."""
    return F.transform(F.when(line.contains("<"), state_bodies(line)).otherwise(F.when(line.isNotNull(), F.array().cast("array<string>"))), decode)


def any_broken(state: Column) -> Column:
    return state["bits"].bitwiseAND(F.lit(15)) != 0


def has_unselected_candidate(state: Column) -> Column:
    return (state["selection"] == DECLINED) & state["cand_version"].isNotNull()


def blocks_as_new_dependency(state: Column) -> Column:
    return (state["mode"] == MODES["H"]) & state["cur_version"].isNull() & state["cand_version"].isNotNull()


def is_unsatisfiable_virtual(state: Column) -> Column:
    return state["cur_version"].isNull() & state["cand_version"].isNull()


def vocabulary(tokens_df, states_col: str = "states"):
    """(token, known, n): flag tokens of all states, decoded or not."""
    # the same flags come again and again: they are counted whole before they are parted; what is exploded is no plain column, for
    # which Spark would add a filter that works the states out again
    flags = F.transform(states_col, lambda s: F.struct(s["raw"].alias("raw"), s["unknown_tokens"].alias("u")))
    whole = tokens_df.select(F.explode(flags).alias("s")).groupBy("s.raw", "s.u").agg(F.count(F.lit(1)).alias("n"))
    parts = whole.select(F.explode(F.filter(F.split(F.regexp_replace("raw", "^@", ""), r"\s+"), lambda t: t != "")).alias("token"), "u", "n")
    return parts.groupBy("token", (~F.array_contains("u", F.col("token"))).alias("known")).agg(F.sum("n").alias("n"))
