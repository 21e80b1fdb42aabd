"""Kinds of application links by host and path."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "UNKNOWN"
# Platforms by their domains, in the order in which they are tried.
PLATFORMS = {
    "MOKA": ["mokahr.com"],
    "BEISEN": ["beisen.com", "zhiye.com"],
    "FEISHU": ["jobs.feishu.cn"],
    "HOTJOB": ["hotjob.cn"],
    "ZHAOPIN": ["zhaopin.com"],
    "JOB_51": ["51job.com"],
    "GUOPIN": ["iguopin.com"],
    "WECHAT": ["weixin.qq.com"],
}
# companies' own domains on a platform.
BEISEN_OWN = [
    "campus.boe.com", "career.h3c.com", "career.mindray.com", "career.naura.com", "career.shenzhouintl.com", "careers.mxbc.com",
    "careers.narwal.com", "hr-campus.vivo.com", "job.lzlj.com", "sunzhaopin.sinosig.com", "we.zyt.com", "zhaopin.xa.com",
    "zhaopin.xdf.cn",
]
# Other recruitment systems, public portals, forms and short links.
CUSTOM = [
    "ciicscjob.com", "exam-sp.com", "hersingdat.com", "hire66.com", "izhanchi.com", "pzhl.net", "recruitee.com", "sun-hrm.com",
    "tupu360.com", "wscloud.kingdee.com",
]
PORTALS = ["cqrc.net", "czrsj.cn", "fzrsrc.cn", "gxrc.com", "hbggzp.cn", "ncrczpw.com", "qgsydw.com", "yingjiesheng.com"]
FORMS = [
    "bsurl.cn", "bit.ly", "dqr.cn", "docs.google.com", "docs.popo.netease.com", "f.kdocs.cn", "f.wps.cn", "forms.office.com",
    "is.gd", "jinshuju.net", "jsj.top", "jsjform.com", "send2me.cn", "t.cn", "t.co", "tinyurl.com", "url.cn", "wj.toutiao.com",
    "wjx.cn", "wjx.com", "wjx.top",
]
# Words in places of official notices and of companies' career pages, and keys of redirects.
NOTICE_MARKS = [
    "gzw.", "mohrss.", "rsj.", "rsc.", "hrss.", "gqzp", "notice", "rcdw", "rczp", "recruit", "renshi", "rencai", "talent",
    "tzgg", "zhaopin",
]
CAREER_MARKS = ["apply", "career", "campus", "hr", "job", "join", "outreach", "recruit", "talent", "zhaopin"]
REDIRECTS = ["jumpurl", "next", "redirect", "redirect_uri", "returnurl", "targeturl", "url"]
# The patterns of a form's path and of an email address.
FORM_PATH = "(?i)/(form|forms|survey|questionnaire)(/|$)"
EMAIL = r"(?U)(?<![\w.+-])[\w.+-]+@[\w-]+(\.[\w-]+)+(?![\w.-])"

_WEB = r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:@]+)(?::\d*)?([^?#]*)"


def host_under(host: Column, domains: list[str]) -> Column:
    """One pattern a kind: the host is one of the domains or below it."""
    return host.rlike(rf"(^|\.)({'|'.join(map(re.escape, domains))})$")


def _any_of(text: Column, marks: list[str]) -> Column:
    return text.rlike("|".join(map(re.escape, marks)))


def _by_place(url: Column) -> Column:
    host = F.rtrim(F.lower(F.regexp_extract(url, _WEB, 1)), F.lit("."))
    path = F.regexp_extract(url, _WEB, 2)
    place = F.lower(F.concat(host, path))
    out = F.when((host == "") | host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$|^\["), UNKNOWN)
    for kind, domains in PLATFORMS.items():
        out = out.when(host_under(host, domains), kind)
    return (
        out.when(host_under(host, BEISEN_OWN), "BEISEN")
        .when(host_under(host, CUSTOM), "CUSTOM_RECRUITMENT_SYSTEM")
        .when(host.endswith(".gov.cn") & _any_of(place, NOTICE_MARKS), "GOVERNMENT_NOTICE")
        .when(host_under(host, PORTALS), "PUBLIC_RECRUITMENT_PORTAL")
        .when(host_under(host, FORMS) | host.startswith("form.") | path.rlike(FORM_PATH), "FORM_OR_SHORT")
        .when(_any_of(place, CAREER_MARKS), "COMPANY_RECRUITMENT_SITE")
        .when(host.startswith("www."), "COMPANY_WEBSITE")
        .otherwise(UNKNOWN)
    )


def link_type(url: Column) -> Column:
    """The kind of a link; a link that leads on to a known kind has that kind. Null is UNKNOWN."""
    text = F.trim(F.coalesce(url, F.lit("")))
    web = text.rlike(_WEB)
    query = rf"(?i)[?&](?:{'|'.join(REDIRECTS)})=([^&#]*)"
    targets = F.transform(F.regexp_extract_all(text, F.lit(query), 1), lambda t: F.coalesce(F.try_url_decode(t), F.lit("")))
    known = F.filter(F.transform(targets, _by_place), lambda k: k != UNKNOWN)
    return (
        F.when(web, F.coalesce(F.get(known, F.lit(0)), _by_place(text)))
        .when(text.startswith("mailto:") | text.rlike(EMAIL), "EMAIL")
        .otherwise(UNKNOWN)
    )
