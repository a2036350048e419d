"""Scoring and classifying titles by configurable term groups and ordered rule cascades."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

HEAVY_GROUPS = ("climate_core", "ghg", "ets")


@dataclass(frozen=True)
class TierTerms:
    """The vocabulary of the tier cascade; all of it is configuration."""

    non_consulting: Sequence[str] = ()
    science_only: Sequence[str] = ()
    domain_1: Sequence[str] = ()
    work_1: Sequence[str] = ()
    planning: Sequence[str] = ()
    science_project: Sequence[str] = ()
    domain_2: Sequence[str] = ()
    support_2: Sequence[str] = ()
    equipment_2: Sequence[str] = ()
    application_2: Sequence[str] = ()
    goods: Sequence[str] = ()
    private_buyer: Sequence[str] = ()
    topic: Sequence[str] = ()
    # The patterns below, unless others are given.
    auction: str = "경매사업"
    topic_pattern: str = "기후(?!부)"
    feasibility: Sequence[str] = (r"해외\s*(?:환경|녹색|재생에너지|수소|ccus)\s*프로젝트", r"타당성\s*조사", "지원사업", "모집|공고")
    feasibility_not: str = "결과|선정|마감|취소|국제감축"
    reasons: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class GrantPatterns:
    """What the titles of grant calls say."""

    domain: str = "(?i)탄소중립|배출권거래제|온실가스|탄소감축|저탄소|국제감축|외부사업|CBAM|기후공시|기후 공시"
    support: str = "(?i)설비|시설|프로젝트 경매|융자|이차보전|이자지원|금리지원|투자지원|투자 지원|컨설팅|인벤토리"
    call: str = "공고|모집"
    funding: str = r"지원사업|지원\s*사업|경매사업|융자지원|이차보전|기업지원|지원\s*(?:\([^)]*\))?\s*참여기업"
    role: str = r"수행사\s*모집|검증기관\s*모집|원가계산기관\s*모집|선정\s*결과|구매\s*입찰|납품\s*입찰|시공\s*입찰|용역\s*입찰|평가\s*결과|기술평가결과|설명회|세미나|교육|행사|사전\s*안내"
    research: str = "기술개발|실증|시험|r&d"
    installs: str = r"설비\s*(?:도입|설치|투자)|컨설팅"
    advice: str = "컨설팅|인벤토리|공시"
    advice_domain: str = "온실가스|배출권|탄소|cbam|기후"
    reduction: str = "국제감축|외부사업"
    equipment: str = "설비|시설|융자|이차보전|이자지원|금리지원|투자지원|투자 지원|프로젝트 경매"


def score_text(df: DataFrame, column: str, groups: Mapping[str, Sequence[str]], tender: Sequence[str] = (), heavy: Sequence[str] = HEAVY_GROUPS) -> DataFrame:
    """Adds score (3 a heavy group, 2 another, 1 a tender term) and keywords."""
    text = T.normalize_text(F.col(column))
    score = sum((F.when(T.any_term(text, terms), 3 if g in heavy else 2).otherwise(0) for g, terms in groups.items()), F.lit(0))
    score = score + sum((F.when(T.contains_term(text, t), 1).otherwise(0) for t in tender), F.lit(0))
    every = [*dict.fromkeys(t for terms in (*groups.values(), tender) for t in terms)]
    return df.withColumns({"score": score, "keywords": F.when(T.any_term(text, every), T.matched_terms(text, every)).otherwise(F.array().cast("array<string>"))})


def with_excluded(df: DataFrame, column: str, terms: Sequence[str]) -> DataFrame:
    return df.withColumn("excluded_terms", T.matched_terms(T.normalize_text(F.col(column)), terms))


def relevant(df: DataFrame, column: str, groups, tender, excluded: Sequence[str], least: int = 2) -> DataFrame:
    scored = with_excluded(score_text(df, column, groups, tender), column, excluded)
    return scored.filter((F.size("excluded_terms") == 0) & (F.col("score") >= least))


def domain_required(df: DataFrame, keywords: str, domain: Sequence[str]) -> DataFrame:
    return df.filter(F.arrays_overlap(F.transform(keywords, F.lower), F.array(*[F.lit(t.lower()) for t in domain])))


def overseas_feasibility(title: Column, terms: TierTerms) -> Column:
    text, out = T.normalize_text(title), ~T.normalize_text(title).rlike(terms.feasibility_not)
    for p in terms.feasibility:
        out = out & text.rlike(p)
    return out


def tier_cascade(title: Column, category: Column, buyer: Column, method: Column, terms: TierTerms) -> Column:
    """struct<tier, reason, signals>; the first rule that holds."""
    none = F.array().cast("array<string>")

    def is_(tier: int, rule: str, signals: Column = none) -> Column:
        return F.struct(F.lit(f"tier_{tier}").alias("tier"), T.tier_reason(terms.reasons.get(rule, rule), signals).alias("reason"), signals.alias("signals"))

    return _cascade(T.normalize_text(title), category, buyer, method, terms, is_)


def tier_of_text(text: Column, category: Column, buyer: Column, method: Column, terms: TierTerms) -> Column:
    """The cascade's tier alone, of a title that is normalised already."""
    return _cascade(text, category, buyer, method, terms, lambda tier, *_: F.lit(f"tier_{tier}"))


def _cascade(text: Column, category: Column, buyer: Column, method: Column, terms: TierTerms, is_: Callable[..., Column]) -> Column:
    cat = F.coalesce(category, F.lit(""))
    has = lambda name: T.has_signal(text, getattr(terms, name))
    found = lambda *names: F.array_distinct(F.concat(*[T.signals(text, getattr(terms, n)) for n in names]))
    grant, research = cat == "grant_application", has("science_project") & ~has("planning")
    supported = has("domain_2") & has("support_2") & has("equipment_2") & ~cat.startswith("g2b_")
    supplier = ~has("application_2") & (has("goods") | ((F.trim(F.coalesce(method, F.lit(""))) != "") & T.has_signal(F.lower(F.coalesce(buyer, F.lit(""))), terms.private_buyer)))
    aid = F.array_distinct(F.concat(found("domain_2"), found("support_2"), found("equipment_2")))
    return (
        F.when(text == "", is_(3, "no title")).when(has("non_consulting"), is_(3, "not advisory", found("non_consulting")))
        .when(grant & overseas_feasibility(text, terms), is_(1, "overseas feasibility"))
        .when(grant & research, is_(3, "technology development"))
        .when(grant & has("domain_2") & has("equipment_2") & (has("support_2") | text.contains(terms.auction)), is_(2, "equipment grant", aid))
        .when(grant & has("domain_2") & has("support_2") & has("domain_1") & has("work_1"), is_(2, "advice grant", found("domain_2", "support_2", "work_1")))
        .when(grant, is_(3, "other grant"))
        .when(supported & supplier, is_(3, "supplier purchase")).when(supported, is_(2, "support programme", aid))
        .when(~has("domain_1"), is_(3, "no domain")).when(has("science_only"), is_(3, "laboratory", found("science_only")))
        .when(research, is_(3, "technology development")).when(has("work_1"), is_(1, "advisory work", found("domain_1", "work_1")))
        .otherwise(is_(3, "no advisory work"))
    )


def related_reference(title: Column, tier: Column, terms: TierTerms) -> Column:
    return related_text(T.normalize_text(title), tier, terms)


def related_text(text: Column, tier: Column, terms: TierTerms) -> Column:
    return tier.isin("tier_1", "tier_2") | ((tier == "tier_3") & (T.has_signal(text, terms.topic) | text.rlike(terms.topic_pattern)))


def climate_title(title: Column, excluded: Sequence[str], terms: TierTerms) -> Column:
    none = F.lit("")
    return ~T.any_term(T.normalize_text(title), excluded) & related_reference(title, tier_cascade(title, none, none, none, terms)["tier"], terms)


def title_policy(title: Column, groups: Mapping[str, Sequence[str]], tender: Sequence[str], excluded: Sequence[str], policy: Mapping, terms: TierTerms) -> Column:
    """struct<tier, score, keywords, strong>: strong, needs_review or ignore."""
    text, none = T.normalize_text(title), F.lit("")
    every = [*dict.fromkeys(t for g in (*groups.values(), tender) for t in g)]
    keywords = T.matched_terms(text, every)
    score = sum((F.when(T.any_term(text, t), 3 if g in HEAVY_GROUPS else 2).otherwise(0) for g, t in groups.items()), F.lit(0)) + sum((F.when(T.contains_term(text, t), 1).otherwise(0) for t in tender), F.lit(0))
    of = lambda names: [t for g in names for t in groups.get(g, ())]
    domain, strong = of(policy["domain_keyword_groups"]), of(policy["strong_keyword_groups"])
    generic = {t.lower() for t in policy["generic_environment_terms"]}
    specific = [t for t in groups.get("environment", ()) if t.lower() not in generic]
    explicit, advisory = policy["explicit_consulting_environment_terms"], policy["advisory_terms"]
    fit = tier_cascade(title, none, none, none, terms)
    both = lambda a, b: F.array_sort(F.array_distinct(F.concat(T.matched_terms(text, a), T.matched_terms(text, b))))
    row = lambda tier, s, hits: F.struct(F.lit(tier).alias("tier"), s.alias("score"), keywords.alias("keywords"), hits.alias("strong"))
    out = F.when(fit["tier"].isin("tier_1", "tier_2") & ~T.any_term(text, excluded), row("strong", F.greatest(F.lit(3), score), fit["signals"]))
    out = out.when(~T.any_term(text, domain), row("ignore", score, F.array().cast("array<string>")))
    if policy.get("enabled", True) is False:
        return out.otherwise(row("strong", score, T.matched_terms(text, domain)))
    out = out.when(T.any_term(text, strong) | T.any_term(text, explicit), row("strong", score, both(strong, explicit)))
    return out.when(T.any_term(text, specific) & T.any_term(text, advisory), row("strong", score, both(specific, advisory))).otherwise(row("needs_review", score, T.matched_terms(text, domain)))


def customer_grant(title: Column, p: GrantPatterns = GrantPatterns()) -> Column:
    return title.rlike(p.domain) & title.rlike(p.support) & title.rlike(p.call) & title.rlike(p.funding) & ~title.rlike(p.role)


def portfolio_grant(title: Column, p: GrantPatterns = GrantPatterns()) -> Column:
    text = F.lower(title)
    return customer_grant(title, p) & F.when(text.rlike(p.research) & ~text.rlike(p.installs), False).when(text.rlike(p.advice), text.rlike(p.advice_domain)).when(text.rlike(p.reduction), True).otherwise(text.rlike(p.equipment))


def history_relevance(df: DataFrame, title: str, categories: Mapping[str, Sequence[str]], specific: Sequence[str], excluded: Sequence[str]) -> DataFrame:
    """Adds categories, hits, specific_hits, exclusions, status (core, review, exclude), reason."""
    text = T.normalize_text(F.col(title))
    every = [*dict.fromkeys(t for terms in categories.values() for t in terms)]
    named = F.array_compact(F.array(*[F.when(T.any_term(text, t), F.lit(c)) for c, t in categories.items()]))
    out = df.withColumns({"categories": F.array_sort(named), "hits": T.matched_terms(text, every), "specific_hits": T.matched_terms(text, specific), "exclusions": T.matched_terms(text, excluded)})
    some, core = F.size("categories") > 0, F.size("specific_hits") > 0
    return out.withColumns({
        "status": F.when(core, "core").when(some, "review").otherwise("exclude"),
        "reason": F.when(core, "specific term").when(some & (F.size("exclusions") == 0), "possible relation").when(some, "related and excluded terms").otherwise("no context"),
    })
