"""Addresses as built-in expressions; who and what they name is said by tables of rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from marginalia.functions.rules import Address, compiled, within


def host(url: Column) -> Column:
    """Lower-case host without www, user info and port; the scheme may be missing."""
    h = F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.regexp_replace(h, r"^www\.", "")


#: Parameters that say how a reader came, not which post it is.
TRACKING = "fbclid gclid gclsrc dclid msclkid yclid twclid mc_cid mc_eid igshid _hsenc _hsmi".split()


def post_key(url: Column) -> Column:
    """blog:host/path?query without fragment, trailing slash and tracking parameters, the query sorted; ``blog:`` for none."""
    u = F.trim(F.coalesce(url, F.lit("")))
    path = F.regexp_replace(F.regexp_extract(u, r"^(?:[a-zA-Z][\w+.-]*://)?[^/?#]*([^?#]*)", 1), "/+$", "")
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(f"^(utm_[^=]*|{'|'.join(TRACKING)})(=|$)")))
    return F.concat(F.lit("blog:"), host(u), path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


#: Second-level labels that belong to a country's registry.
SECOND_LEVEL = ("co", "com", "org", "net", "gov", "edu", "ac", "gob", "go")
#: Other names of one platform.
SAME = {"twitter.com": "x.com", "mobile.twitter.com": "x.com"}
#: Hosts that are never an identity.
EXCLUDED = ".youtube.com .youtu.be .linkedin.com .spotify.com .podcasts.apple.com .apple.co .pod.link .overcast.fm .pca.st"
#: Hosts on which every page is a paper.
PAPER_HOSTS = ("arxiv.org", "doi.org", "biorxiv.org", "medrxiv.org", "openreview.net", "pubmed.ncbi.nlm.nih.gov", "aclanthology.org")

#: Whose page an address is, by host and path; an empty name is no one's.
ACCOUNTS = [
    ("scholar.google.com", r"^[^?]*\?(?:[^#]*&)?user=([^&]+)", "{host}/citations?user={1:decoded}"),
    ("scholar.google.com", "", ""),
    (".semanticscholar.org", r"^/+author/+(?:[^?]*/)?([^/?]+)/*(?:\?|$)", "semanticscholar.org/author/{1}"),
    (".semanticscholar.org", "", ""),
    ("orcid.org", r"^/+(\d{4}-\d{4}-\d{4}-\d{3}[\dX])(?:[/?]|$)", "{host}/{1}"),
    ("orcid.org", "", ""),
    (".dblp.org", r"^/+((?:pid|pers)/+[^?]*[^/?])/*(?:\?|$)", "dblp.org/{1:stem}"),
    (".dblp.org", "", ""),
    (".researchgate.net", r"^/+profile/+([^/?]+)", "researchgate.net/profile/{1:lower}"),
    (".researchgate.net", "", ""),
    (".academia.edu", r"^/+(\d*[^/?\d][^/?]*)", "{host}/{1:lower}"),
    ("*.academia.edu", r"^/*(?:\?|$)", "{host}"),
    (".academia.edu", "", ""),
    ("arxiv.org", r"^/+a/+([^/?]+)", "{host}/a/{1}"),
    ("github.com", r"^/+orgs/+([^/?]+)", "{host}/{1:lower}"),
    ("github.com x.com medium.com gitlab.com", r"^/+([^/?]+)", "{host}/{1:lower}"),
    ("any", "", "{host}"),
]

#: What an address points at.
KINDS = [
    (".github.com", "", "github"),
    (".substack.com", "", "substack"),
    (" ".join(f".{h}" for h in PAPER_HOSTS), "", "paper"),
    ("huggingface.co", "(?i)^/papers/", "paper"),
    ("ncbi.nlm.nih.gov pmc.ncbi.nlm.nih.gov", "(?i)^/(?:pmc/)?articles/", "paper"),
    ("europepmc.org", r"(?i)^/(?:(?:article|abstract)/(?:MED|PMC|PPR)/|articles?/PMC\d)", "paper"),
    ("openalex.org", r"(?i)^/W\d+", "paper"),
    ("semanticscholar.org api.semanticscholar.org", "(?i)^/(?:paper/|CorpusID:)", "paper"),
    (".ssrn.com", r"(?i)^/\S*?abstract(?:_id)?=\d", "paper"),
    ("zenodo.org", r"(?i)^/records?/\d", "paper"),
    ("alphaxiv.org", "(?i)^/(?:abs|pdf|overview)/", "paper"),
    ("eprint.iacr.org", r"^/\d{4}/\d", "paper"),
    ("eccc.weizmann.ac.il", r"(?i)^/report/\d{4}/\d", "paper"),
    ("any", r"url /10\.\d{4,9}/[^\s?#]", "paper"),
    ("any", r"url (?i)^[^?]*\.pdf(?:\?|$)", "paper"),
]

#: Hosts whose links are never an article, and shapes that are never a document: home pages, jobs, events, forms, logins, shops.
NO_ARTICLE = (
    ".gist.github.com .gist.githubusercontent.com .chatgpt.com .chat.openai.com .grok.com .claude.ai .youtube.com .youtu.be .podcasts.apple.com .music.apple.com "
    ".open.spotify.com .twitch.tv .discord.gg .discord.com"
)
LINK_ONLY = [
    ("any", r"^/?(?:\?|$)", "home"),
    (".boards.greenhouse.io .job-boards.greenhouse.io .jobs.lever.co .jobs.ashbyhq.com .eventbrite.com .lu.ma .luma.com .forms.gle .drive.google.com .lnkd.in", "", "hosted"),
    ("docs.google.com", "^/forms", "hosted"),
    ("any", r"url (?i)^https?://(?:www\.)?(?:jobs|careers|tickets|events|sso|login|shop|store)\.", "section"),
    (
        "any",
        "(?i)^[^?]*/(?:jobs?|careers?|apply|join|events?|tickets?|register|reg|shop|store|checkout|pricing|sign-?up|sign-?in|login|account|forms|get-involved|advertise)(?:[/?]|$)",
        "section",
    ),
]

#: Parts of paths on two platforms that are no account.
NO_GITHUB = (
    "about account apps codespaces collections contact customer-stories dashboard education enterprise events explore features issues join login marketplace mobile new nonprofit "
    "notifications organizations orgs pricing pulls readme search security settings site sponsors team topics trending"
)
NO_X = "home explore notifications messages search settings i intent hashtag compose login logout signup tos privacy about share"
_first = lambda words: f"(?i)^/+(?:{words.replace(' ', '|')})(?:[/?]|$)"

#: Type, whether it is a profile, shape and handle of what an address shows.
PROFILES = [
    ("arxiv.org", r"(?i)^/+a(?:/+[^/?]+)?/+([^/?]+)/*(?:\?|$)", "scholar yes personal {1}"),
    ("arxiv.org", r"(?i)^/+a(?:/|\?|$)(?:[^?]*/)?([^/?]*)", "scholar no personal {1}"),
    ("arxiv.org doi.org biorxiv.org medrxiv.org papers.ssrn.com openreview.net aclanthology.org dl.acm.org pubmed.ncbi.nlm.nih.gov *.arxiv.org", "", "paper no unknown"),
    ("any", r"(?i)^[^?]*\.pdf(?:\?|$)", "paper no unknown"),
    ("github.com", r"(?i)^/+orgs/+([^/?]+)", "github yes org {1:lower}"),
    ("github.com", rf"(?:^/*(?:\?|$)|{_first(NO_GITHUB)})", "github no unknown"),
    ("github.com", r"^/+([^/?]+)/*(?:\?|$)", "github yes personal {1:lower}"),
    ("github.com", r"^/+([^/?]+)", "github no personal {1:lower}"),
    ("gitlab.com", rf"(?:^/*(?:\?|$)|{_first('explore help - users')})", "gitlab no unknown"),
    ("gitlab.com", r"^/+([^/?]+)/*(?:\?|$)", "gitlab yes personal {1:lower}"),
    ("gitlab.com", r"^/+([^/?]+)", "gitlab no personal {1:lower}"),
    ("x.com", rf"(?:^/*(?:\?|$)|{_first(NO_X)})", "x no unknown"),
    ("x.com", r"(?i)^/+([^/?]+)/+status/+[^/?]", "x no personal {1:lower}"),
    ("x.com", r"^/+([^/?]+)", "x yes personal {1:lower}"),
    ("substack.com", "", "substack no unknown"),
    ("*.substack.com", r"(?i)^/+p(?:[/?]|$)", "substack no personal {label}"),
    ("*.substack.com", "", "substack yes personal {label}"),
    ("medium.com", r"^/+@([^/?]*)/*(?:\?|$)", "blog yes personal {1:lower}"),
    ("medium.com", r"^/+@([^/?]*)", "blog no personal {1:lower}"),
    ("medium.com", "", "blog no unknown"),
    ("*.medium.com", r"^/*(?:\?|$)", "blog yes personal {label}"),
    ("*.medium.com", "", "blog no personal {label}"),
    ("scholar.google.com", r"^/citations/*\?(?:.*&)?user=([^&]+)", "scholar yes personal {1:decoded}"),
    ("scholar.google.com", r"^/citations/*(?:\?|$)", "scholar no personal"),
    ("scholar.google.com", "", "scholar no unknown"),
    (".semanticscholar.org", r"(?i)^/+author(?:/+[^/?]+)?/+([^/?]+)/*(?:\?|$)", "scholar yes personal {1}"),
    (".semanticscholar.org", r"(?i)^/+author(?:/|\?|$)(?:[^?]*/)?([^/?]*)", "scholar no personal {1}"),
    (".semanticscholar.org", "", "scholar no unknown"),
    ("orcid.org", r"^/+([^/?]+)/*(?:\?|$)", "orcid yes personal {1}"),
    ("orcid.org", r"^/*([^/?]*)", "orcid no personal {1}"),
    (".dblp.org", r"(?i)^/+(?:pid|pers)/(?:[^?]*/)?([^/?]+)/*(?:\?|$)", "scholar yes personal {1:stem}"),
    (".dblp.org", "", "scholar no unknown"),
    (".researchgate.net", r"(?i)^/+profile/+([^/?]+)", "scholar yes personal {1:lower}"),
    (".researchgate.net", "", "scholar no unknown"),
    ("*.academia.edu", r"^/*(?:\?|$)", "scholar yes personal {label}"),
    (".academia.edu", r"^/+(\d*[^/?\d][^/?]*)/*(?:\?|$)", "scholar yes personal {1:lower}"),
    (".academia.edu", "", "scholar no unknown"),
]

#: The key of a paper by its address.
PAPERS = [
    ("any", r"url (?i)arxiv\.org/(?:abs|pdf|html)/([^?#]+?)(?:v\d+)?(?:\.pdf)?(?:[?#].*)?$", "arXiv:{1}"),
    ("any", r"url (?i)(?:huggingface\.co/papers|alphaxiv\.org/(?:abs|pdf|overview))/(\d{4}\.\d{4,5})", "arXiv:{1}"),
    ("any", r"url (?i)/10\.48550/arxiv\.([^\s?#]+?)(?:v\d+)?/*(?:[\s?#]|$)", "arXiv:{1}"),
    ("any", r"url /(10\.1101/[^\s?#]+?)(?:v\d+(?:\.full(?:-text)?)?(?:\.pdf)?)?(?:/(?i:full|fulltext|full-text|html|pdf|epdf|abstract|meta|references|citations|figures|supplemental|supplementary|summary))*[./]*(?:[\s?#]|$)", "DOI:{1:lower}"),
    ("any", r"url /(10\.\d{4,9}/[^\s?#]+?)(?:/(?i:full|fulltext|full-text|html|pdf|epdf|abstract|meta|references|citations|figures|supplemental|supplementary|summary))*[./]*(?:[\s?#]|$)", "DOI:{1:lower}"),
    ("any", r"url (?i)ssrn\.com/\S*?abstract(?:_id)?=(\d+)", "DOI:10.2139/ssrn.{1}"),
    ("any", r"url (?i)semanticscholar\.org/paper/(?:[^/]+/)?(CorpusID:\d+|[0-9a-f]{40}|\d+)", "{1}"),
    ("any", r"url (?i)openreview\.net/(?:forum|pdf)\?id=([^\s&#]+)", "openreview:{1}"),
    ("any", r"url (?i)(eprint\.iacr\.org/\d{4}/\d+|eccc\.weizmann\.ac\.il/report/\d{4}/\d+)", "url:{1:lower}"),
    ("any", r"url ^(?i:https?)://([^/?#]+)(/[^?#]*\.(?i:pdf))(?:[?#]|$)", "url:{1:lower}{2}"),
]
#: The number of a post.
POSTS = [("x.com mobile.x.com", r"(?i)^/+[^/?]+/status(?:es)?/(\d+)", "{1}")]
#: Kinds that a reader may claim for an address.
CLAIMS = ("github", "substack", "paper", "x", "article")


def web(url: Column) -> Column:
    """Whether an address has a web scheme and a host."""
    return F.coalesce(F.trim(url).rlike(r"(?i)^https?://[^/?#\s]"), F.lit(False))


def _usable(at: Address) -> Column:
    port = r"(?::\d{0,5})?"
    form = at.url.rlike(rf"(?i)^https?://(?:[^/?#@\s]*@)?[^/?#:\s]+{port}(?:[/?#]\S*)?$") | at.url.rlike(r"^[^/?#:\s]*[^/?#:\s.]\.[^/?#:\s]+(?:[/?#][^:\s]*)?$")
    return form & ~at.on(EXCLUDED)


def usable(url: Column) -> Column:
    """Whether a text is the address of a web page or a bare host with a dot, without white space, and on no platform that is left out."""
    return within(url, _usable)


def account(url: Column) -> Column:
    """Whose page an address is: the account on platforms that have them, the host elsewhere; empty if it names no one."""
    return within(url, lambda at: F.when(_usable(at), compiled(ACCOUNTS, at)).otherwise(""), SAME)


def link_kind(url: Column) -> Column:
    """github, substack, paper (a known host or page, a DOI in the path, a PDF) or null."""
    return within(url, lambda at: compiled(KINDS, at))


def link_only(url: Column) -> Column:
    """What makes an address no document, by its shape alone: home, hosted or section; null if nothing does."""
    return within(url, lambda at: compiled(LINK_ONLY, at))


def reference_kind(url: Column) -> Column:
    """What a link in a trusted post becomes: github, paper, substack, x (a post), article; null for what becomes nothing."""

    def said(at: Address) -> Column:
        nothing = ~web(at.url) | at.on(NO_ARTICLE) | compiled(LINK_ONLY, at).isNotNull()
        on_x = F.when(compiled(POSTS, at).isNotNull(), "x")
        return F.when(~nothing, F.when(at.on(".x.com .twitter.com"), on_x).otherwise(F.coalesce(compiled(KINDS, at), F.lit("article"))))

    return within(url, said, SAME)


def card_link(url: Column) -> Column:
    """Whether a link that is no document is worth a card."""
    return within(url, lambda at: web(at.url) & ~at.on(NO_ARTICLE) & ~at.on(".x.com .twitter.com") & compiled(LINK_ONLY, at).isNotNull())


def hand_reference(url: Column, claim: Column) -> Column:
    """(kind, basis) of an address that a person gave: what it shows, else what the reader claims, else an article."""
    shown = F.coalesce(link_kind(url), F.when(post_id(url).isNotNull(), "x"))
    said = F.when(claim.isin(*CLAIMS), claim)
    basis = F.when(~web(url), "none").when(shown.isNotNull(), "sniffed").when(said.isNotNull(), "hint").otherwise("fallback")
    return F.struct(F.when(web(url), F.coalesce(shown, said, F.lit("article"))).alias("kind"), basis.alias("basis"))


def profile(url: Column) -> Column:
    """(type, is_profile, shape, handle) of an address with a web scheme; null if it names no one. Other sites are blogs, and their home page is the profile."""

    def said(at: Address) -> Column:
        home = F.when(at.rest.rlike(r"^/*(?:\?|$)"), "yes").otherwise("no")
        known = F.coalesce(compiled(PROFILES, at), F.concat_ws(" ", F.lit("blog"), home, F.lit("unknown"), site_label(at.host)))
        return F.when(web(at.url) & _usable(at) & (compiled(ACCOUNTS, at) != ""), known)

    words = F.split(within(url, said, SAME), " ")
    part = lambda i: F.nullif(F.get(words, F.lit(i)), F.lit(""))
    found = F.struct(part(0).alias("type"), (part(1) == "yes").alias("is_profile"), part(2).alias("shape"), part(3).alias("handle"))
    return F.when(words.isNotNull(), found)


def paper_id(url: Column) -> Column:
    """The key under which a paper is kept, whatever page of it an address is: arXiv, DOI, Semantic Scholar, OpenReview, a report, a PDF; null for no paper."""
    return within(url, lambda at: compiled(PAPERS, at))


def post_id(url: Column) -> Column:
    """The number of a post on x.com or twitter.com (with www or mobile before it), or null."""
    return within(url, lambda at: F.when(web(at.url), compiled(POSTS, at)), SAME)


def site_label(found: Column) -> Column:
    """The label that a site is registered under: left of the top level, and of a country's second level if there is one; null for an empty host."""
    second = "|".join(SECOND_LEVEL)
    return F.nullif(F.regexp_extract(F.regexp_replace(found, r"^\.+|\.+$", ""), rf"([^.]+)(?:\.(?:{second})\.[^.]+|\.[^.]+)?$", 1), F.lit(""))
