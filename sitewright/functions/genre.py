"""Genres of sites (X24): URL shares and text marks as features, then the first rule that holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a dot stands for: anything but a line's end.
_ANY = r"[^\n\r\u2028\u2029]*"


def _pattern(p: str) -> str:
    return p.replace(".*", _ANY)


def _n(text: Column, *patterns: str) -> Column:
    """How many of the patterns occur."""
    return reduce(lambda a, b: a + b, (text.rlike(_pattern(p)).cast("int") for p in patterns))


def _segment(names: str) -> str:
    return rf"(?i)/(?:{names})(?:/|\?|#|\z)"


# First names of path segments that are counted, by what they tell.
_SEGMENTS = {
    "docs": "docs?|api|reference|guide", "api": "api|reference|endpoints?|sdk", "help": "help|support|faq|kb|knowledge(?:-|_)?base",
    "blog": "blog|posts?|articles?", "listings": "businesses?|places?|people|companies|listings?|profiles?|directory",
    "desks": "politics|world|business|sports|opinion|technology|arts|style|entertainment|culture",
    "events": "schedule|speakers?|sessions?|agenda|venue|register", "shop": "collections|products|shop|cart",
}


def counts(url: str = "url", order: str = "pos") -> list[Column]:
    """A2-A4: aggregates over a site's URLs, by which its genre is told: how many there are and how many have a segment.
    ``*_last`` says whether the last one has: in the joined list of URLs only that one's end counts as an end."""
    hit = lambda names: F.col(url).rlike(_segment(names))
    inner = lambda names: F.col(url).rlike(rf"(?i)/(?:{names})(?:/|\?|#)")
    out = [F.count("*").alias("total"), *(F.count_if(hit(names)).alias(k) for k, names in _SEGMENTS.items())]
    joined = ((k, F.max(inner(_SEGMENTS[k])) | F.max_by(hit(_SEGMENTS[k]), order)) for k in ("docs", "shop"))
    return out + [c.alias(f"{k}_joined") for k, c in joined]


def genre(html: Column, n: Column, host: Column) -> Column:
    """From the home page, the struct of ``counts`` over all discovered URLs, and the host. Marks below are fixed values."""
    text = F.lower(html)
    total = F.greatest(n["total"], F.lit(1))
    share = lambda k: n[k] / total
    docs, blog = n["docs"], n["blog"]
    api, help_ = share("api"), share("help")
    rules: list[tuple[str, Column]] = [
        ("landing_page", (total <= 4) & (_n(text, r"\bcoming soon\b|\blaunching soon\b|\bbeta\b.*\b(signup|waitlist)\b", r"\bnotify me\b|\bjoin the waitlist\b|\bearly access\b", r"\bget updates\b|\bsubscribe\b.*\bnewsletter\b") >= 1)),
        ("government", host.rlike(r"\.gov(\.[a-z]{2,3})?\z|\.mil\z") | (_n(text, r"\bfederal register\b|\bdepartment of\b.*\b(health|labor|defense|justice|education|state)\b", r"\b(city|county|state) of\b.*\b(services?|government|offices?)\b", r"\bpublic records\b|\bforms and applications\b|\bmunicipal (code|services?)\b", r"\boffice of the\b.*\b(mayor|governor|secretary|commissioner|attorney)\b") >= 2)),
        ("academic_research", host.rlike(r"\.edu(\.[a-z]{2,3})?\z|\.ac\.[a-z]{2,3}\z") | (_n(text, r"\bfaculty\b.*\b(research|publications?)\b|\badmissions\b.*\b(graduate|undergraduate)\b", r"\bcurriculum\b|\bcourse catalog\b|\bsyllab(us|i)\b", r"\bphd\b|\bdissertation\b|\bpeer[- ]reviewed\b|\bscholarly\b", r"\blaborator(y|ies)\b.*\b(principal|director)\b|\bresearch group\b") >= 2)),
        ("api_reference", (api > 0.35) | ((api > 0.15) & (_n(text, r"\bapi reference\b|\brest api\b|\bgraphql\b", r"\bendpoints?\b|\brequest\s+(parameters?|body|headers?)\b", r"\b(bearer|oauth|api key)\b.*\bauthentication\b") >= 2))),
        ("technical_knowledge_base", _n(text, r"\b(specification|standard|rfc\s+\d+|w3c|iana|ietf)\b", r"\bnormative reference\b|\bconformance\b|\btechnical (reference|standard)\b", r"\bbrowser compatibility\b|\bimplementation notes?\b") >= 2),
        ("help_center", (help_ > 0.3) | ((help_ > 0.1) & (_n(text, r"\bhelp (center|article)\b|\bsupport portal\b", r"\bfrequently asked\b|\btroubleshooting\b|\bcontact support\b", r"\bsubmit a (ticket|request)\b|\bhow do i\b.*\?") >= 2))),
        ("developer_docs", (docs > total * 0.2) | (_n(text, r"\bdocumentation\b|\bapi reference\b|\bsdk\b|\bgetting started\b|\bquickstart\b|\binstallation\b", r"npm install|pip install|brew install|yarn add|cargo add|go get ") + n["docs_joined"].cast("int") >= 2)),
        ("marketplace", _n(text, r"\bbecome a (seller|host|vendor)\b|\blist your (property|space|product)\b", r"\b(verified|top[- ]rated) (seller|host|vendor)\b", r"\bmarketplace\b.*\b(sellers?|listings?)\b", r"\breviews? from\b.*\b(guests?|buyers?|customers?)\b") >= 2),
        ("ecommerce_store", _n(text, r"\badd to cart\b|\bbuy now\b|\bshopping cart\b|\bcheckout\b", r"\bfree shipping\b|\breturn policy\b|\bshopping bag\b|\bin stock\b") + n["shop_joined"].cast("int") >= 2),
        ("directory_listing", (share("listings") > 0.25) | (_n(text, r"\bdirectory\b.*\b(businesses?|listings?|members?)\b", r"\bfind a\b.*\b(business|doctor|lawyer|provider|dentist|agent)\b", r"\brated\s+\d(\.\d)?\s+stars?\b.*\bbased on\b") >= 2)),
        ("media_publication", ((share("desks") > 0.2) | (_n(text, r"""href=["']/by/[a-z]""", r"\bbreaking news\b|\bnewsroom\b|\bwire (report|service)\b", r"\bsubscriber[- ]only\b|\b(digital|print) subscription\b", r"\bupdated\s+\d+\s+(minute|hour|hr)s?\s+ago\b") >= 2)) & (docs < total * 0.05)),
        ("blog", (docs < total * 0.1) & ((blog / total > 0.2) | ((blog > 0) & (_n(text, r"\bpublished\b|\bauthor\b|\bbyline\b|\bnewsletter\b", r"\bread more\b|\bfull article\b|\bmin read\b") >= 2)))),
        ("saas_product", (docs == 0) & (_n(text, r"\blog in\b|\blogin\b|\bsign in\b", r"\b(start|try)\s+(free|for free|trial|now)\b|\bfree\s+plan\b", r"\bpricing\b.*\b(plans?|per (month|year|user|seat))\b", r"\bbook (a )?demo\b|\bschedule (a )?call\b|\btalk to sales\b") >= 3)),
        ("marketing_site", (docs == 0) & (_n(text, r"\bfeatures?\b.*\bintegrations?\b|\btrusted by\b.*\b(leading|\d+\s+(companies|teams))\b", r"\bpricing\b|\bget a quote\b|\bcontact sales\b", r"\btestimonials?\b|\bcustomer stor(y|ies)\b", r"\b(start|try|get)\s+(free|for free|started|a demo)\b") >= 2)),
        ("community_forum", _n(text, r"\breplies?\b.*\bthread\b|\b(latest|trending) topics?\b|\bdiscussion board\b", r"\bforum\b.*\b(members?|rules|guidelines)\b", r"\bposted by\b.*\b\d+\s+(minute|hour|day)s?\s+ago\b", r"powered by (discourse|phpbb|vbulletin|xenforo)") >= 2),
        ("social_platform", _n(text, r"\bfollowers?\b.*\bfollowing\b|\btimeline\b.*\b(home|for you)\b", r"\b(your|public) feed\b|\bdirect messages?\b", r"\b(post|share) (a|an|your)\s+(status|update|photo|video)\b", r"\b(like|comment|repost|retweet|reshare)s?\b.*\bprofile\b") >= 2),
        ("event_site", (share("events") > 0.15) | (_n(text, r"\bconference\b.*\b(20\d\d|agenda|schedule|speakers?)\b", r"\bkeynote\b|\bregister(ed)? (for|now)\b.*\bevent\b|\btickets?\b.*\b(available|sold out)\b", r"\bvenue\b.*\b(address|location)\b|\bday\s+(one|two|three|1|2|3)\s+agenda\b", r"\bcall for (papers|proposals|speakers)\b|\bworkshop\b.*\bspeakers?\b") >= 3)),
        ("entertainment", _n(text, r"\bwatch\s+(now|on demand|online)\b|\bstream(ing)?\b.*\b(movies?|shows?|series|music)\b", r"\bsoundtrack\b|\btracklist\b|\balbum\b.*\brelease\b|\bep(isode)?\s+\d+\b|\bseason\s+\d+\b", r"\bgame\s+(trailer|features|gameplay)\b|\bplatform\b.*\b(ps5|xbox|switch|steam|pc)\b", r"\bnow playing\b|\bcoming soon\b.*\b(theat(er|re)s?|release)\b") >= 2),
        ("nonprofit", _n(text, r"\b501\(c\)\(3\)\b|\btax[- ]deductible\b", r"\bdonate\b.*\b(now|today|monthly|one[- ]time)\b|\brecurring (donation|gift)\b", r"\bcharit(y|able)\b|\bfoundation\b.*\bmission\b", r"\bgrants? (program|funding)\b|\bour impact\b|\bbeneficiar(y|ies)\b") >= 2),
        ("corporate", _n(text, r"\binvestor relations\b|\bannual report\b|\bearnings (call|release|report)\b", r"\bboard of directors\b|\bexecutive (team|leadership)\b|\bshareholders?\b", r"\b(press|media) (release|kit)\b.*\b(company|corporation)\b", r"\b(nasdaq|nyse|lse|tsx):\s*[a-z]+\b") >= 2),
        ("portfolio", _n(text, r"\b(our|selected|recent|featured) (work|projects?|case studies)\b", r"\bclient list\b|\bcase studies\b", r"\bdesign studio\b|\b(creative|digital) agency\b") >= 2),
        ("personal", _n(text, r"\bportfolio\b|\bfreelance\b|\bhire me\b|\bresume\b|\bmy work\b|\babout me\b", r"\b(i'?m|i am) a\b.*\b(designer|developer|photographer|writer|consultant|engineer|artist)\b") >= 2),
    ]
    return F.coalesce(*(F.when(F.coalesce(test, F.lit(False)), name) for name, test in rules), F.lit("generic"))
