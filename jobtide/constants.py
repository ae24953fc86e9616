"""Fixed values that results depend on: vocabularies, patterns, host lists, weights."""

# Target matches and their ranks.
TARGET_RANK = {"not_internship": -1, "wrong_year": -1, "wrong_season": -1, "unknown": 0, "source_confirmed": 1, "year_confirmed": 2, "exact": 3}
TARGETS = ("exact", "year_confirmed", "source_confirmed")
# Source modes and their ranks, else 99.
SOURCE_RANK = {"direct": 0, "verification": 1, "verification-lead": 2, "external-index": 2, "registry": 3, "universe-seed": 4}
EMPLOYER_DATE_MODES = ("direct", "verification")
INDEX_MODES = ("registry", "external-index", "verification-lead")
# Categories that count as technical.
TECH = ("software", "ml-ai", "data", "security", "hardware", "quant", "product")
# Kinds that cover no board.
FALLBACK_KINDS = ("verification",)
# Statuses of results that are not whole.
BAD_STATUSES = ("broken", "blocked", "truncated", "partial")
# Query keys that never identify an application.
TRACKING_KEYS = ("source", "src", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gh_src", "lever-source", "ref", "jr_id", "iis", "iisn")
# Query keys of clicks.
CLICK_KEYS = ("fbclid", "gclid", "dclid", "msclkid", "mc_cid", "mc_eid", "igshid", "vero_conv", "vero_id")
# Hosts where no application can be made.
NON_APPLICATION_HOSTS = ("github.com", "www.github.com", "simplify.jobs", "www.simplify.jobs", "speedyapply.com", "www.speedyapply.com", "discord.gg", "www.linkedin.com", "jobright.ai", "www.jobright.ai", "workopia.io", "www.workopia.io", "visasponsor.jobs", "www.visasponsor.jobs")
# Company keys and the names shown for them.
COMPANY_ALIASES = {
    "alphabet": "Google", "google": "Google", "google llc": "Google", "google inc": "Google", "databricks": "Databricks", "databricks inc": "Databricks",
    "de shaw": "D. E. Shaw", "d e shaw": "D. E. Shaw", "d. e. shaw": "D. E. Shaw", "d.e. shaw": "D. E. Shaw", "the d. e. shaw group": "D. E. Shaw", "the d e shaw group": "D. E. Shaw",
    "bae systems": "BAE Systems", "bae systems inc": "BAE Systems", "northrop grumman": "Northrop Grumman", "northrop grumman corporation": "Northrop Grumman",
    "susquehanna international group sig": "Susquehanna International Group", "susquehanna international group": "Susquehanna International Group", "sig": "Susquehanna International Group",
    "hudson river trading": "Hudson River Trading", "hrt": "Hudson River Trading", "tiktok": "TikTok", "byte dance": "ByteDance", "bytedance": "ByteDance", "cvs health": "CVS Health", "cvs health corporation": "CVS Health",
}
# Legal forms at the end of a name.
LEGAL_SUFFIX = r"\b(incorporated|inc|llc|ltd|limited|corp|corporation|co|company|plc|gmbh|sa|ag)\.?$"
# Patterns of internship evidence, cycles and categories (first hit wins).
INTERN = r"\b(intern(ship)?|co[- ]?op|industrial placement|student placement|summer placement)\b"
PROGRAM = r"\b(summer (?:technology|engineering|software|product|quantitative|trading|research|data) (?:analyst|associate|program)|student researcher|university (?:program|role)|campus (?:program|role)|technology summer analyst|engineering summer associate)\b"
YEAR = r"\b20(?:2[5-9]|3[0-5])\b"
SUMMER_2027 = r"\b(?:summer\W{0,12}2027|2027\W{0,12}summer)\b"
SEASONS = {"summer": r"\bsummer\b", "fall": r"\b(fall|autumn)\b", "spring": r"\bspring\b", "winter": r"\bwinter\b"}
CATEGORIES = {
    "quant": r"\b(quant(?:itative)?|trading|trader|systematic|research analyst)\b",
    "ml-ai": r"\b(machine learning|artificial intelligence|\bai\b|deep learning|computer vision|nlp|language model|generative ai)\b",
    "software": r"\b(software|developer|frontend|backend|full[- ]?stack|mobile|ios|android|site reliability|sre|devops|platform engineer|cloud engineer|technology analyst)\b",
    "data": r"\b(data scientist|data engineer|data analyst|analytics|business intelligence|database engineer)\b",
    "security": r"\b(security|cyber|penetration|vulnerability|threat intelligence)\b",
    "hardware": r"\b(hardware|silicon|firmware|embedded|electrical|fpga|asic|robotics|semiconductor)\b",
    "product": r"\b(product manager|product management|program manager|product design|ux|ui)\b",
    "other-technical": r"\b(engineer(?:ing)?|technology|technical|computer science|information systems|solutions architect|systems analyst)\b",
}
# Provider host fragments; one that ends in a dot matches anywhere.
PROVIDERS = {
    "greenhouse.io": "greenhouse", "lever.co": "lever", "ashbyhq.com": "ashby", "myworkdayjobs.com": "workday", "smartrecruiters.com": "smartrecruiters", "recruitee.com": "recruitee", "workable.com": "workable",
    "jobvite.com": "jobvite", "icims.com": "icims", "oraclecloud.com": "oracle-cloud", "successfactors.": "successfactors", "rippling.com": "rippling", "teamtailor.com": "teamtailor", "bamboohr.com": "bamboohr",
    "dayforcehcm.com": "dayforce", "eightfold.ai": "eightfold", "phenompeople.com": "phenom", "phenom.com": "phenom", "ukg.com": "ukg",
}
# Public suffixes of two labels.
MULTIPART_SUFFIXES = ("co.uk", "com.au", "com.br", "com.mx", "co.jp", "co.in", "co.nz", "com.sg")
# What career hosts begin with, and what career and job links hold.
CAREER_SUBDOMAINS = ("jobs.", "job.", "careers.", "career.", "recruiting.", "recruitment.", "talent.", "join.", "work.")
CAREER_MARKERS = ("career", "careers", "job", "jobs", "join-us", "join_us", "work-with-us", "open-position", "open-role", "opportunit", "vacanc", "requisition")
DETAIL_MARKERS = ("/job/", "/jobs/", "/position/", "/positions/", "/opening/", "/openings/", "/requisition/", "/requisitions/", "/apply/", "/details/")
APPLY_MARKERS = ("/job/", "/jobs/", "/position/", "/positions/", "/careers/", "/apply", "/details/", "/results/", "/search/")
# A job's id in a link, words of titles that tell nothing, and what closed pages say.
JOB_ID = r"(?i)(?:/|[?&])(?:job|jobs|jobid|job_id|gh_jid|req|requisition)[=/_-]?[0-9a-f-]{3,}"
TITLE_STOPWORDS = ("a", "an", "and", "apply", "at", "career", "careers", "co", "job", "jobs", "of", "the", "to", "intern", "internship", "summer", "2027")
CLOSED = r"(?i)\b(?:job (?:is )?no longer available|position (?:is )?no longer available|position has been filled|job has expired|requisition (?:is )?no longer available|no longer accepting applications|this (?:job|position) (?:is )?closed|the page you requested (?:could not be found|does not exist))\b"
# Failure labels and the tokens that give them, in order.
FAILURES = (
    ("timeout", ("timeout", "timed out")), ("dns", ("enotfound", "name or service not known", "dns")), ("tls", ("ssl", "tls", "certificate")), ("blocked_or_rate_limited", ("403", "429", "blocked", "forbidden", "rate limit")),
    ("missing_or_dormant", ("404", "410", "dormant", "not found", "gone")), ("incomplete_enumeration", ("truncated", "partial", "incomplete", "pagination")), ("parse_or_schema", ("parse", "decode", "json", "xml", "schema")),
    ("persistence", ("database", "postgres", "supabase", "persist", "constraint")), ("unsupported_source", ("unsupported", "unknown source kind")), ("classification_rejected", ("not_internship", "wrong_year", "wrong_season", "no relevant")),
)
# Crawl interval in seconds and priority by kind; historical sources: 86400 and 500.
CADENCE = {
    "greenhouse": (900, 10), "lever": (900, 10), "ashby": (900, 10), "smartrecruiters": (1200, 20), "recruitee": (1200, 20), "workable": (1200, 20), "workday-search": (1800, 30), "google-careers": (1200, 30),
    "jobvite": (1800, 40), "icims": (1800, 40), "oracle-cloud": (1800, 40), "successfactors": (1800, 40), "verification": (3600, 80), "domain": (21600, 120),
}
# Headers of tables by what stands below them, and marks that repeat the company above.
COMPANY_HEADERS = ("company", "employer", "firm", "organization", "organisation")
TITLE_HEADERS = ("role", "position", "title", "job", "internship", "job title", "position title")
LOCATION_HEADERS = ("location", "locations", "office", "city")
TIME_HEADERS = ("age", "added", "date", "date added", "date posted", "posted")
SAME_COMPANY = ("", "↳", "—", "-", "⬆")
CLOSED_MARK = "🔒"
# Where pages keep links besides anchors, and anchors that name no job.
EMBEDDED_ATTRIBUTES = (("iframe", "src"), ("form", "action"), ("script", "src"), ("embed", "src"), ("object", "data"))
DATA_ATTRIBUTES = ("data-url", "data-src", "data-href", "data-job-url", "data-careers-url", "data-apply-url")
STRUCTURED_KEYS = ("url", "sameAs", "applicationUrl", "applyUrl", "target")
MICRODATA = ("url", "applicationurl", "applyurl")
GENERIC_ANCHORS = ("learn more", "apply", "share", "details")
DIRECTORY_HOSTS = ("www.ycombinator.com", "ycombinator.com")
# Names of elements of job feeds in XML, and of roots that are feeds.
XML_RECORDS = ("job", "position", "posting", "opening", "requisition", "vacancy", "item", "entry")
XML_JOBS = ("job", "position", "posting", "opening", "requisition", "vacancy")
XML_URLS = ("url", "joburl", "job-url", "detailurl", "detail-url", "applyurl", "apply-url", "applicationurl", "application-url", "link", "guid", "loc")
XML_TITLES = ("title", "jobtitle", "job-title", "positiontitle", "position-title")
XML_IDS = ("id", "jobid", "job-id", "requisitionid", "requisition-id", "reference")
XML_ADDRESSES = ("href", "url", "joburl", "job-url", "applyurl", "apply-url", "applicationurl", "application-url")
XML_FEEDS = ("rss", "feed", "rdf")
# Entries of sitemaps, and what names their address and their time.
SITEMAP_ENTRIES, SITEMAP_PLACES, SITEMAP_TIMES = ("url", "sitemap", "item", "entry"), ("loc", "link"), ("lastmod", "updated", "pubdate", "published")
# Keys of titles in a page's JSON, and keys that say that an object is a job.
TITLE_KEYS = ("jobTitle", "job_title", "positionTitle", "position_title", "title", "name")
JOB_SIGNAL_KEYS = ("applyUrl", "apply_url", "description", "employmentType", "employment_type", "jobDescription", "jobId", "job_id", "locations", "requisitionId", "requisition_id")
# Attributes of the elements that hold a page's job title, each with its value or a part of it, and the meta elements that do.
TITLE_ATTRIBUTES = (("data-automation-id", "jobPostingHeader"), ("data-testid", "job-title"))
# Fixed value: what says "intern" in a page.
PAGE_INTERN = r"\b(?:intern(?:ship)?|co[- ]?op|industrial placement)\b"
TITLE_CLASSES = ("job-title", "jobTitle")
TITLE_METAS = (("property", "og:title"), ("name", "twitter:title"), ("name", "title"))

# Keys of JSON feeds that hold links, and those whose values are jobs.
FEED_URL_KEYS = ("url", "absoluteurl", "hostedurl", "joburl", "detailurl", "externalurl", "applyurl", "applicationurl", "applicationlink", "applylink", "redirecturl", "next", "nexturl", "nextpage", "nextpageurl")
JOB_CONTAINERS = ("jobs", "jobpostings", "postings", "positions", "openings", "requisitions", "vacancies")
# Names that are no tenant.
PATH_DENY = ("admin", "api", "app", "assets", "auth", "blog", "cdn", "docs", "embed", "help", "login", "static", "status", "support", "www")
SUBDOMAIN_DENY = ("admin", "api", "app", "assets", "auth", "cdn", "login", "static", "www")
# What alerts call the categories, and what a title says where its category is a rest.
CATEGORY_LABELS = {"software": "Software", "ml-ai": "ML / AI", "data": "Data", "security": "Security", "hardware": "Hardware", "quant": "Quant", "product": "Product", "other": "Other technical", "other-technical": "Other technical"}
INFERRED_LABELS = (
    (("machine learning", "artificial intelligence", " ai ", " ml "), "ML / AI"), (("information technology", " it intern", " it internship"), "IT"), (("software", "developer", "programmer"), "Software"), (("data", "analytics"), "Data"),
    (("security", "cyber"), "Security"), (("hardware", "firmware", "electrical"), "Hardware"), (("quant", "trading"), "Quant"), (("product",), "Product"),
)
# Steps that make text visible, and what is cut from its edges.
CLEANING = (
    (r"(?i)<\s*br\s*/?\s*>|</p>|</div>|</li>", " | "), (r"(?i)^\[(.+)\]\(https?://[^)]+\)$", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"<[^>]+>", " "), ("&amp;", "&"), ("&nbsp;|\u00a0", " "), ("\ufe0f", ""),
    (r"[\x{1F1E6}-\x{1F1FF}]{2}", ""), (r"[\x{1F300}-\x{1FAFF}\x{2700}-\x{27BF}\x{2B00}-\x{2BFF}]+", ""), (r"\s+", " "),
)
EDGES = " *\t|·-—–"
# Steps that take presentation noise out of lower-case titles, and levels after intern titles.
TITLE_NOISE = (
    (r"\s+(?:-|–|—|\|)\s+(?:remote|hybrid|onsite|on-site|[a-z .'-]+,\s*[a-z]{2}|[a-z .'-]+,\s*(?:usa|united states))$", ""), (r"\[(?:remote|hybrid|onsite|on-site)\]", ""), (r"\s*\((?:remote|hybrid|onsite|on-site)\)\s*$", ""),
    (r"\s*\((?:summer|fall|spring|winter)\s+20\d{2}\)\s*$", ""), (r"\b(?:summer|fall|spring|winter)\s+20\d{2}\b", ""), (r"[^a-z0-9+#./ -]+", " "), (r"\s+", " "),
)
LEVEL = r"\b(?:i{1,3}|iv|v|1|2|3|4|5)\b$"
# States that may stand joined to the next place, places that say nothing, and places all over the country.
STATES = "AL|AK|AZ|AR|CA|CO|CT|DE|FL|GA|HI|IA|ID|IL|IN|KS|KY|LA|MA|MD|ME|MI|MN|MO|MS|MT|NC|ND|NE|NH|NJ|NM|NV|NY|OH|OK|OR|PA|RI|SC|SD|TN|TX|UT|VA|VT|WA|WI|WV|WY"
EMPTY_PLACES = ("", "—", "-", "–", "not stated", "location not stated", "n/a")
ALL_OVER = ("(multiple us)", "multiple u.s. locations", "multiple us locations")
# How alerts name a source's kind, and the kinds whose second part is named too.
SOURCE_LABELS = {
    "ashby": "Ashby", "direct": "Employer site", "domain": "Employer site", "external-index": "External index", "greenhouse": "Greenhouse", "lever": "Lever", "registry": "Registry", "rippling": "Rippling", "smartrecruiters": "SmartRecruiters",
    "teamtailor": "Teamtailor", "verification": "Employer page verified", "verification-lead": "Verification lead", "workday": "Workday",
}
SOURCE_DETAILS = ("external-index", "registry", "verification-lead")
