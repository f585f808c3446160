"""Domain categories by suffix and by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Category names and the domains and suffixes that define them.
EDUCATION_SUFFIXES = (
    ".edu", ".ac.uk", ".ac.jp", ".ac.kr", ".ac.at", ".ac.za", ".ac.ir", ".ac.rs",
    ".edu.tw", ".edu.au", ".edu.ar", ".edu.pl", ".edu.br",
)
GOVERNMENT_SUFFIXES = (
    ".gov", ".gov.au", ".gov.uk", ".go.jp", ".gouv.fr", ".gouv.qc.ca", ".gov.ru",
    ".gov.sk", ".gov.bc.ca", ".admin.ch", ".gc.ca", ".mil",
)
OPEN_KNOWLEDGE = (
    "wikipedia.org", "wiktionary.org", "wikimedia.org", "wikisource.org", "wikibooks.org",
    "wikiquote.org", "wikinews.org", "wikidot.com", "wikivoyage.org", "wikiversity.org",
    "wikileaks.org",
)
RESEARCH = (
    "nih.gov", "nasa.gov", "noaa.gov", "nist.gov", "cern.ch", "cnrs.fr", "mpg.de",
    "worldbank.org", "un.org", "fao.org", "si.edu",
)
TECHNOLOGY = (
    "github.com", "github.io", "google.com", "microsoft.com", "apple.com", "mozilla.org",
    "adobe.com", "oracle.com", "ibm.com", "redhat.com", "debian.org", "ubuntu.com",
    "fedoraproject.org", "apache.org", "freebsd.org", "android.com", "atlassian.net",
    "atlassian.com", "salesforce.com", "sap.com", "kde.org", "opensuse.org", "eclipse.org",
    "mathworks.com", "googlesource.com", "launchpad.net",
)
HOSTING = (
    "blogspot.com", "wordpress.org", "hatenablog.com", "substack.com", "wixsite.com", "wix.com",
    "weebly.com", "neocities.org", "netlify.app", "herokuapp.com", "azurewebsites.net", "web.app",
    "appspot.com", "cloudfront.net", "firebaseapp.com", "shopify.com", "godaddy.com",
    "over-blog.com", "tistory.com", "seesaa.net", "exblog.jp", "cocolog-nifty.com",
    "livedoor.biz", "livedoor.blog", "livejournal.com", "hatenablog.jp", "hateblo.jp",
    "hatena.ne.jp", "blog.jp", "ning.com", "sakura.ne.jp", "xrea.com", "pixnet.net",
)
COMMERCE = (
    "amazon.com", "alibaba.com", "made-in-china.com", "rakuten.co.jp", "shein.com",
    "banggood.com", "shop-pro.jp", "jd.com",
)
MEDIA = (
    "indiatimes.com", "rbc.ru", "voanews.com", "elpais.com", "chinadaily.com.cn",
    "itmedia.co.jp", "hindustantimes.com", "obozrevatel.com", "cbsnews.com", "espn.com",
    "ndtv.com", "cnet.com", "ria.ru", "err.ee", "tvp.pl", "as.com",
)


def _ends_with(domain: Column, suffixes: tuple[str, ...]) -> Column:
    quoted = "|".join(s.replace(".", r"\.") for s in suffixes)
    return domain.rlike(rf"(?:{quoted})\z")


def categorise_domain(domain: Column) -> Column:
    """Category of a domain; the first rule that holds decides."""
    d = F.lower(domain)
    wiki = "|".join(s.replace(".", r"\.") for s in OPEN_KNOWLEDGE)
    return (
        F.when(_ends_with(d, EDUCATION_SUFFIXES) | d.contains(".edu."), "Education")
        .when(_ends_with(d, GOVERNMENT_SUFFIXES) | d.contains(".gov"), "Government")
        .when(d.rlike(rf"(?:^|\.)(?:{wiki})\z"), "Open Knowledge")
        .when(d.isin(*RESEARCH), "Research")
        .when(d.isin(*TECHNOLOGY), "Technology")
        .when(d.isin(*HOSTING), "Hosting/Platform")
        .when(d.isin(*COMMERCE), "E-commerce")
        .when(d.isin(*MEDIA), "News/Media")
        .when(d.endswith(".eu"), "EU Institutions")
        .otherwise("Other")
    )
