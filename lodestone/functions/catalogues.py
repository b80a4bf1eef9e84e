"""Messages in other languages, by what survives of them.

A message is known by the literal runs between its blanks: a text matches where it holds each
of the first three runs of eight characters or more, in the log's language, else in English,
else by fragments that no language translates.  Catalogues are read with ``gettext`` on the
driver where they are installed; without any, English and the fragments remain.
"""

from __future__ import annotations

import gettext
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DOMAINS = ("libapt-pkg7.0", "libapt-pkg6.0", "apt", "dpkg")
#: Messages, and fragments that stay as they are in every language.
MESSAGES = {
    "held_broken": "Unable to correct problems, you have held broken packages.",
    "resolver_breaks": "Error, pkgProblemResolver::Resolve generated breaks, this may be caused by held packages.",
    "unmet_deps": "Unmet dependencies. Try 'apt --fix-broken install' with no packages (or specify a solution).",
    "dpkg_interrupted": "dpkg was interrupted, you must manually run '%s' to correct the problem. ",
}
FRAGMENTS = {"resolver_breaks": ("pkgProblem", "::Resolve"), "dpkg_interrupted": ("dpkg --configure -a",), "unmet_deps": ("apt --fix-broken install",), "held_broken": ()}
RELATIONS = {"Depends": 6, "PreDepends": 7, "Suggests": 2, "Recommends": 1, "Conflicts": 5, "Replaces": 3, "Breaks": 4}


def language(locale: str | None) -> str | None:
    """``pt_BR.UTF-8`` to ``pt_BR``; none for English, C and POSIX."""
    m = re.match(r"([A-Za-z]{2,3})(?:[_-]([A-Za-z]{2,}))?", locale or "")
    if not m or (locale or "").upper().startswith(("C.", "POSIX")) or m[1].lower() == "en":
        return None
    return m[1].lower() + (f"_{m[2].upper()}" if m[2] else "")


def localised(message: str, locale: str | None, folder: str = "/usr/share/locale") -> str:
    lang = language(locale)
    for domain in DOMAINS if lang else ():
        told = gettext.translation(domain, folder, [lang, lang.split("_")[0]], fallback=True).gettext(message)
        if told != message:
            return told
    return message


def runs(message: str) -> list[str]:
    return [r for r in (p.strip() for p in re.split(r"%\d*\$?[a-z]|\n", message)) if len(r) >= 8][:3]


def said(text: Column, key: str, locale: str | None = None, folder: str = "/usr/share/locale") -> Column:
    """Whether a text is the message ``key``."""
    both = lambda parts: reduce(lambda a, b: a & b, [text.contains(p) for p in parts]) if parts else F.lit(False)
    forms = {localised(MESSAGES[key], locale, folder), MESSAGES[key]}
    return reduce(lambda a, b: a | b, [both(runs(m)) for m in sorted(forms)]) | both(FRAGMENTS[key])


def relation_aliases(languages: list[str], folder: str = "/usr/share/locale") -> dict[str, int]:
    """Names of relations in the installed languages, to their codes."""
    found = {}
    for lang in languages:
        for name, code in RELATIONS.items():
            told = localised(name, lang, folder).strip().lower()
            if told != name.lower():
                found[told] = code
    return found
