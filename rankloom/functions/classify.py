"""Pattern classifiers over domains, URLs and anchor texts."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom.functions import rules
from rankloom.functions.text import bind
from rankloom.functions.urls import path


def _any_of(patterns: Sequence[str]) -> str:
    return "|".join(re.escape(p) for p in patterns)


def under_domain(domain: Column, parents: Sequence[str]) -> Column:
    """The domain is one of ``parents`` or below one of them."""
    return domain.rlike(rf"(?:^|\.)(?:{_any_of(parents)})$")


def _domain_rule(patterns: Sequence[str]) -> str:
    """Patterns with a dot match whole domain endings, the others match anywhere."""
    parents = [p for p in patterns if "." in p]
    words = [p for p in patterns if "." not in p]
    rules_found = []
    if parents:
        rules_found.append(rf"(?:^|\.)(?:{_any_of(parents)})$")
    if words:
        rules_found.append(_any_of(words))
    return "|".join(rules_found)


def domain_type(domain: Column, table: Mapping[str, Sequence[str]]) -> Column:
    """First category whose patterns match the domain, NULL when none does."""
    picked = F
    for category, patterns in table.items():
        picked = picked.when(domain.rlike(_domain_rule(patterns)), category)
    return picked.otherwise(None)


def _contains_any(text: Column, words: Sequence[str]) -> Column:
    return F.exists(_word_table(words), lambda word: F.contains(text, word))


def text_type(text: Column, table: Mapping[str, Sequence[str]]) -> Column:
    """First category with a pattern inside the lower-cased text, NULL when none.

    Plain substring search is several times faster than one alternation per category.
    """

    def pick(bound: Column) -> Column:
        picked = F
        for category, patterns in table.items():
            picked = picked.when(_contains_any(bound, patterns), category)
        return picked.otherwise(None)

    return bind(F.lower(text), pick)


def action_v1(link_type: Column, brand: str) -> Column:
    picked = F
    for keys, action in rules.ACTIONS_V1:
        picked = picked.when(link_type.rlike(_any_of(keys)), action.format(brand=brand))
    return picked.otherwise(rules.DEFAULT_ACTION_V1)


def page_class(url: Column) -> Column:
    """Class of a page by the first directory of its path."""
    trimmed = F.lower(F.btrim(path(url), F.lit("/")))
    folder = F.regexp_extract(trimmed, r"^([^/]*)", 1)
    picked = F.when(trimmed == "", rules.HOMEPAGE)
    for label, folders in rules.PAGE_CLASSES.items():
        picked = picked.when(folder.isin(*folders), label)
    return picked.otherwise(F.concat(F.lit("Other (/"), folder, F.lit("/)")))


def page_plan(keyword: Column, commercial: Column, transactional: Column, navigational: Column) -> Column:
    """Kind of page to build for a keyword; the first rule that holds decides."""
    text = F.lower(keyword)
    return (
        F.when(navigational | text.rlike(_any_of(rules.INTEGRATION_WORDS)), "integration")
        .when(commercial | transactional | text.rlike(_any_of(rules.HUB_WORDS)), "hub")
        .when(text.rlike(_any_of(rules.TOOL_WORDS)), "tool")
        .otherwise("blog")
    )


def plan_text(plan: Column, field: int, brand: str) -> Column:
    picked = F
    for kind, texts in rules.PAGE_PLANS.items():
        picked = picked.when(plan == kind, texts[field].replace("{brand}", brand))
    return picked.otherwise(None)


def _word_table(patterns: Sequence[str]) -> Column:
    """The patterns as one constant array."""
    return F.split(F.lit("\n".join(patterns)), "\n")


#: Patterns of one mask: the bits of a long without its sign.
MASK_BITS = 63


def mask_parts(patterns: Sequence[str]) -> list[Sequence[str]]:
    """The patterns of each mask of a table; one mask holds 63, a longer table has several."""
    return [patterns[i : i + MASK_BITS] for i in range(0, len(patterns), MASK_BITS)]


def _mask(text: Column, patterns: Sequence[str]) -> Column:
    none = F.lit(0).cast("bigint")
    bits = [F.when(F.contains(text, F.lit(p)), F.lit(1 << i).cast("bigint")).otherwise(none) for i, p in enumerate(patterns)]
    while len(bits) > 1:  # a balanced tree: a chain of 63 would be as deep
        bits = [x[0].bitwiseOR(x[1]) if len(x) == 2 else x[0] for x in (bits[i : i + 2] for i in range(0, len(bits), 2))]
    return bits[0]


def pattern_masks(text: Column, patterns: Sequence[str]) -> list[Column]:
    """One bit per pattern found in ``text``, in as many masks as the table needs.

    Masks of many rows combine with ``bit_or``, so the evidence of a domain with any number of rows is a few numbers and no
    text of a group is ever put together. Each pattern is an expression of its own, which Spark compiles.
    """
    return [_mask(text, part) for part in mask_parts(patterns)]


def mask_words(masks: Sequence[Column], patterns: Sequence[str], limit: int) -> Column:
    """The first ``limit`` patterns of a table's masks, in table order, as text."""
    one = F.lit(1).cast("bigint")

    def seen(mask: Column, part: Sequence[str]) -> Column:
        return F.filter(_word_table(part), lambda word, at: F.call_function("shiftright", mask, at).bitwiseAND(one) == one)

    found = [seen(mask, part) for mask, part in zip(masks, mask_parts(patterns), strict=True)]
    return F.array_join(F.slice(F.concat(*found), 1, limit), ", ")


def asset_path(lower_path: Column) -> Column:
    """The lower-cased path ends in the extension of a static file; a name that is only an extension does not."""
    extension = F.substring_index(lower_path, ".", -1)
    return extension.isin(*rules.ASSET_EXTENSIONS) & lower_path.rlike(r"[^./][^/]*\.[^./]+$")


def technical_path(lower_path: Column) -> Column:
    return _contains_any(lower_path, rules.TECHNICAL_PATHS)


def asset_url(url: Column) -> Column:
    return asset_path(F.lower(path(url)))


def technical_url(url: Column) -> Column:
    return technical_path(F.lower(path(url)))
