"""Word lists, patterns and dictionaries whose exact content decides results."""

# Directory and aggregator domains: sources, never businesses.
DIRECTORY_DOMAINS = """
practo.com lybrate.com whatclinic.com healthgrades.com zocdoc.com doctorondemand.com 1mg.com
justdial.com sulekha.com asklaila.com indiamart.com tradeindia.com yellowpages.com yellowpages.in magicpin.in magicpin.com
yelp.com tripadvisor.com zomato.com swiggy.com urbanclap.com urbancompany.com housejoy.in
ambitionbox.com glassdoor.com indeed.com naukri.com linkedin.com amazon.com flipkart.com snapdeal.com
wikipedia.org youtube.com facebook.com instagram.com twitter.com x.com reddit.com pinterest.com quora.com scribd.com
google.com bing.com duckduckgo.com yahoo.com makemytrip.com booking.com airbnb.com
medium.com wordpress.com blogspot.com linktree.com linkin.bio
""".split()
DIRECTORY_NAMES = """
practo magicpin justdial sulekha lybrate indiamart tradeindia yellowpages yelp tripadvisor zomato swiggy urbanclap
urbancompany linkedin facebook instagram twitter youtube wikipedia scribd
""".split()
GENERIC_NAMES = ["home", "index", "results", "search results", "loading", "error", "404", "page not found", "untitled", "website"]
LISTING_TITLE = r"^(?:(?:best|top|all|find|list(?:ing)?|search)\s+)?(?:dental\s+clinics?|dentists?|medical\s+clinics?|hospitals?|restaurants?|salons?|lawyers?)\s+in\s+.+$"
STOP_WORDS = ["in", "the", "and", "or", "a", "an", "of", "for", "with", "at"]
SOURCE_MARKERS = ["best ", "top ", " in ", "directory", "listing", "results"]

# Company names.
LEGAL_SUFFIXES = [r"\bpvt\.?\s*ltd\.?\b", r"\bprivate\s+limited\b", r"\bltd\.?\b", r"\bllc\.?\b", r"\binc\.?\b", r"\bcorporation\b", r"\bcorp\.?\b", r"\bco\.?\b", r"\bllp\.?\b", r"\bplc\.?\b"]
GENERIC_SUFFIXES = ["clinic", "center", "centre", "hospital", "care", "services", "group", "solutions", "consultancy"]
TITLE_BREAK = "[-|–—:•]"

# Contacts.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
MASKED_EMAIL = r"\b([A-Za-z0-9._%+-]+)\s*(?:\[at\]|\(at\)|\bat\b)\s*([A-Za-z0-9.-]+)\s*(?:\[dot\]|\(dot\)|\bdot\b)\s*([A-Za-z]{2,})\b"
EMAIL_STRICT = r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$"
EMAIL_ASSETS = [".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".css", ".js"]
EMAIL_IGNORED_DOMAINS = ["example.com", "domain.com", "email.com", "yourdomain.com", "mysite.com", "sentry.io", "wixpress.com", "wix.com", "wordpress.org"]
EMAIL_IGNORED_PREFIXES = ["user@", "test@", "info@yourdomain.com", "name@", "username@"]
PHONE = r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{2,4}\)?[-.\s]?\d{3,4}[-.\s]?\d{3,5}"
SNIPPET_PHONE = r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
PLAIN_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
CARD_PHONE = r"(?:\+?91[-.\s]?)?(?:\(?0?[6-9]\d{9}\)?|(?:\d{2,4}[-.\s]?\d{6,8}))"
CARD_NOISE = ["magicpin", "practo", "justdial", "sulekha", "lybrate"]
CARD_SELECTORS = ["div[data-qa-id]", "li.result", "div.listing-item", "div.business-card", "div.card", "article", "li[itemscope]", "div[itemscope]"]
LIST_NOISE = ["home", "about", "contact", "login", "sign"]

# Profiles: platform, pattern.
SOCIAL_PATTERNS = {
    "instagram": r"(?i)https?://(?:www\.)?instagram\.com/([a-zA-Z0-9_.]+)/?",
    "facebook": r"(?i)https?://(?:www\.)?facebook\.com/([a-zA-Z0-9_.-]+)/?",
    "linkedin": r"(?i)https?://(?:www\.)?linkedin\.com/(?:company|in)/([a-zA-Z0-9_.-]+)/?",
    "twitter": r"(?i)https?://(?:www\.)?(?:twitter\.com|x\.com)/([a-zA-Z0-9_]+)/?",
    "youtube": r"(?i)https?://(?:www\.)?youtube\.com/(?:@|c/|channel/)?([a-zA-Z0-9_.-]+)/?",
}
SOCIAL_HOSTS = ["instagram.com", "facebook.com", "linkedin.com", "twitter.com", "x.com", "youtube.com"]
SOCIAL_IGNORED = ["share", "sharer", "intent", "sharer.php", "home", "search", "login", "privacy", "terms", "policies", "help", "about", "pages"]
PROFILE_RESERVED = ["p", "reel", "reels", "stories", "explore", "tv", "accounts", "tags", "direct"]

# Structured data.
JSONLD_TARGETS = ["localbusiness", "organization", "dentist", "medicalbusiness", "physician", "store", "professionalservice", "healthandbeautybusiness", "dentistry", "medicalclinic", "hospital", "corporation"]
DIRECTORY_TYPES = ["LocalBusiness", "MedicalBusiness", "Dentist", "Physician", "Restaurant", "Store", "Organization"]

# Links and site maps.
LINK_KEYWORDS = ["contact", "about", "service", "team", "doctor", "dentist", "clinic", "location", "reach-us", "find-us", "our-story", "about-us", "contact-us"]
LINK_ASSETS = [".pdf", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".mp4", ".zip", ".css", ".js", ".xml", ".ico"]
SITEMAP_KEYWORDS = ["contact", "about", "service", "team", "doctor", "clinic", "location", "branch", "pricing", "staff", "meet-the-team"]
SITEMAP_BAD = ["/blog/", "/tag/", "/category/", "/page/", "/author/", "/wp-content/"]
TRACKING = ["fbclid", "gclid", "ref", "source"]
# Public suffixes of two labels, and of one; hosts under others stay whole.
SUFFIXES_2 = ["co.in", "net.in", "org.in", "firm.in", "gen.in", "ind.in", "ac.in", "edu.in", "gov.in", "co.uk", "org.uk", "me.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.za", "com.br", "co.jp", "com.sg", "com.my", "com.mx"]
SUFFIXES_1 = ["com", "net", "org", "in", "io", "co", "ai", "app", "dev", "uk", "us", "de", "fr", "es", "it", "nl", "eu", "au", "ca", "info", "biz", "bio", "edu", "gov", "me", "tv", "xyz", "online", "site", "shop", "clinic", "dental", "health", "agency", "studio", "jp", "br", "mx", "sg", "my", "nz", "za", "ch", "at", "be", "se", "no", "dk", "fi", "pl", "ru", "cn", "kr"]

# Services on offer: names and search keywords, most telling first.
SERVICE_DISPLAY = {"seo": "SEO", "social_media": "Social Media", "branding": "Branding", "website_design": "Website Design", "content_creation": "Content Creation", "digital_marketing": "Digital Marketing"}
SERVICE_KEYWORDS = {
    "seo": ["SEO", "search engine optimization", "SEO services", "SEO agency", "SEO company", "SEO consultant", "SEO expert", "local SEO", "technical SEO", "organic traffic", "Google ranking", "search rankings", "improve Google ranking", "search engine marketing", "on-page SEO", "off-page SEO", "link building", "keyword ranking", "SERP ranking", "Google visibility", "rank on Google"],
    "social_media": ["social media", "social media management", "social media marketing", "social media manager", "Instagram marketing", "Instagram management", "Facebook marketing", "social media agency", "social media services", "content management", "social media strategy", "social media content", "Instagram growth", "Facebook page management", "social media presence", "community management", "social media consultant", "TikTok marketing"],
    "branding": ["branding", "brand identity", "brand design", "rebranding", "brand strategy", "visual identity", "logo design", "brand guidelines", "branding agency", "brand designer", "creative agency", "brand development", "brand refresh", "corporate identity", "brand consulting", "brand positioning", "graphic design", "identity design"],
    "website_design": ["website", "web design", "website design", "web development", "website development", "website redesign", "new website", "web designer", "web developer", "landing page", "website agency", "website builder", "responsive design", "mobile website", "ecommerce website", "website overhaul", "website revamp", "website makeover", "wordpress website"],
    "content_creation": ["content creation", "content marketing", "content creator", "copywriting", "blog writing", "video content", "social media content", "content agency", "content strategy", "content writing", "article writing", "content producer", "storytelling", "content plan", "creative content"],
    "digital_marketing": ["digital marketing", "digital marketing agency", "online marketing", "internet marketing", "performance marketing", "marketing agency", "growth marketing", "paid advertising", "Google ads", "Facebook ads", "PPC", "pay per click", "online advertising", "marketing consultant", "full-service marketing", "inbound marketing"],
}
# Aliases of services; their order decides partial matches.
SERVICE_ALIASES = {
    "seo": "seo", "search engine optimization": "seo", "search engine": "seo",
    "social media": "social_media", "social media management": "social_media", "instagram": "social_media", "facebook marketing": "social_media", "social": "social_media", "instagram marketing": "social_media",
    "branding": "branding", "brand": "branding", "brand identity": "branding", "logo": "branding", "logo design": "branding", "visual identity": "branding", "rebranding": "branding", "creative agency": "branding",
    "website": "website_design", "web design": "website_design", "website design": "website_design", "web development": "website_design", "website development": "website_design", "website redesign": "website_design", "web designer": "website_design", "web developer": "website_design", "landing page": "website_design",
    "content": "content_creation", "content creation": "content_creation", "copywriting": "content_creation", "blog": "content_creation", "content marketing": "content_creation", "writing": "content_creation",
    "digital marketing": "digital_marketing", "online marketing": "digital_marketing", "paid ads": "digital_marketing", "ppc": "digital_marketing", "performance marketing": "digital_marketing", "google ads": "digital_marketing", "facebook ads": "digital_marketing", "marketing": "digital_marketing",
}
INTENT_MODIFIERS = ["looking for", "need", "needs", "seeking", "wanted", "hiring", "hire", "looking to hire", "looking for an agency", "looking for an expert", "looking for someone", "need help with", "need help", "require", "recommendation", "recommend", "anyone recommend", "can anyone suggest", "suggestions for", "searching for", "interested in", "want to improve", "trying to improve", "help needed", "any suggestions", "who should I hire"]
HIGH_INTENT = ["looking to hire", "hiring", "need help", "need", "seeking"]
JOB_BOARDS = ["indeed.", "naukri.", "glassdoor.", "linkedin.com/jobs"]
SOCIAL_SITES = ["facebook.", "instagram.", "x.com", "twitter.", "linkedin."]
FORUMS = ["reddit.", "quora."]
CONTACT_SUFFIXES = ["contact", "phone number", "email", "address", "website"]

# Pages that show nothing without scripts.
EMPTY_APP = r"""(?i)<div\s+id=["'](?:root|app|__next)["']\s*>\s*</div>"""
SCRIPT_PLEAS = ["enable javascript to run this app", "javascript is required"]

# Words that the signal detectors look for.
CTA_WORDS = ["contact", "book", "appointment", "call", "get started", "enquire", "consult", "schedule", "request"]
PHONE_HINTS = ["+", "tel", "phone", "call us", "contact"]
SERVICE_WORDS = ["service", "treatment", "what we do", "our work", "solutions", "offerings", "specializ", "expertise"]
SEMANTIC_TAGS = ["article", "section", "aside", "header", "footer", "main"]
BLOG_WORDS = ["blog", "article", "news", "insights", "resources", "tips", "guide", "post"]
DETAIL_WORDS = ["specialized", "expert", "experience", "professional", "certified", "quality", "trusted", "years", "dedicated", "advanced"]
PROOF_WORDS = ["review", "testimonial", "patient said", "customer said", "client said", "rated", "star", "happy client", "success story"]
GENERIC_HEADINGS = ["welcome", "home", "about us", "our services", "contact us", "gallery"]
NAME_FILLERS = ["the", "and", "for", "with"]
BRAND_FILLERS = ["the", "and", "for", "with", "clinic", "centre", "center"]

# Reason codes and the stage that a code belongs to.
REASON_CODES = ["NOT_A_BUSINESS", "DIRECTORY_SOURCE", "INVALID_COMPANY_NAME", "WRONG_INDUSTRY", "WRONG_LOCATION", "DUPLICATE", "WEBSITE_MISMATCH", "CONTACT_MISMATCH", "NO_CONTACT_METHOD", "LOW_IDENTITY_CONFIDENCE", "INVALID_URL", "INVALID_CONTACT", "EXPLICIT_INTENT_NOT_CONFIRMED", "SOURCE_ERROR", "OTHER"]
CODE_STAGES = {"WRONG_INDUSTRY": "relevance", "WRONG_LOCATION": "location", "NO_CONTACT_METHOD": "contact_validation", "CONTACT_MISMATCH": "contact_validation"}
