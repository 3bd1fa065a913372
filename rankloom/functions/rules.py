"""Rule tables of the classifiers.

Everything here is data: callers may pass their own tables to the operators. The word lists, labels and
thresholds below are fixed values: the results depend on them literally. ``{brand}`` in an action text is
filled with the name of the product the queue is built for.
"""

# --- link type, first rule set (fixed values) ---------------------------------------------------------
# A pattern with a dot is a domain (equal or parent domain); one without is a substring of the domain.

LINK_TYPES_V1 = {
    "App Market (应用市场/生态插件)": (
        "apps.shopify.com", "appstore.com", "apps.apple.com", "play.google.com",
        "wordpress.org", "wordpress.com/plugins", "woocommerce.com/products",
        "marketplace.visualstudio.com", "chrome.google.com/webstore", "addons.mozilla.org",
        "apps.microsoft.com", "zapier.com/apps", "make.com/apps", "slack.com/apps",
        "salesforce.com/appexchange", "hubspot.com/products/marketplace", "canva.com/apps",
        "figma.com/community", "atlassian.com/software/marketplace",
    ),
    "Social / Video (视频社媒)": (
        "youtube.com", "youtu.be", "vimeo.com", "dailymotion.com", "tiktok.com", "instagram.com",
        "pinterest.com", "facebook.com", "twitter.com", "x.com", "threads.net", "snapchat.com",
        "reddit.com", "linkedin.com", "tumblr.com", "flickr.com", "behance.net", "dribbble.com",
    ),
    "Directory / Review (企业目录评价)": (
        "g2.com", "capterra.com", "trustpilot.com", "saashub.com", "sourceforge.net", "producthunt.com",
        "getapp.com", "softwareadvice.com", "alternativeto.net", "slashdot.org", "crunchbase.com",
        "owler.com", "clutch.co", "goodfirms.co", "designrush.com", "serchen.com",
        "financesonline.com", "trustradius.com", "storeleads.app", "builtwith.com", "wappalyzer.com",
    ),
    "Business Directory (商业黄页)": (
        "yelp.com", "yellowpages.com", "bbb.org", "hotfrog.com", "foursquare.com", "manta.com",
        "brownbook.net", "kompass.com", "business.com", "merchantcircle.com", "citysearch.com",
        "mapquest.com",
    ),
    "Forum / Community (论坛社区)": (
        "stackexchange.com", "stackoverflow.com", "medium.com", "dev.to", "hashnode.com",
        "indiehackers.com", "warriorforum.com", "blackhatworld.com", "digitalpoint.com",
        "sitepoint.com", "moz.com/community", "community.shopify.com",
    ),
    "Ecommerce Marketplace (电商平台)": (
        "amazon.com", "ebay.com", "etsy.com", "walmart.com", "aliexpress.com", "alibaba.com",
        "temu.com", "rakuten.com", "shopify.com", "woocommerce.com", "bigcommerce.com", "magento.com",
    ),
    "Coupon Deal Site (优惠券)": (
        "coupon", "coupons", "deal", "deals", "discount", "promo", "voucher", "cashback",
        "retailmenot", "slickdeals", "couponfollow", "dealspotr",
    ),
    "News Media (新闻媒体)": (
        "forbes.com", "entrepreneur.com", "businessinsider.com", "techcrunch.com", "venturebeat.com",
        "mashable.com", "theverge.com", "wired.com", "huffpost.com", "substack.com",
    ),
    "Education Resource (教育资源)": (
        "edu", "coursera.org", "udemy.com", "edx.org", "skillshare.com", "khanacademy.org",
        "codecademy.com",
    ),
    "Affiliate Review (联盟测评)": (
        "review", "reviews", "best", "top", "compare", "versus", "alternative", "guide", "buyer",
    ),
}

URL_TYPES_V1 = {
    "Guest Post": (
        "write-for-us", "writeforus", "guest-post", "guestpost", "guest-blog", "guestblog", "contribute",
        "become-author", "submit-article", "submit-post", "author-guidelines", "editorial-guidelines",
    ),
    "Resource Page": (
        "/resources/", "/resource/", "/library/", "/tools/", "/downloads/", "/free-tools/",
        "/knowledge-base/", "/learning/", "/academy/", "/guide/", "/guides/", "/references/",
    ),
    "Listicle (合集列表)": (
        "best-", "top-", "top10", "top-10", "top20", "top-20", "best-tools", "best-software",
        "best-platforms", "best-companies", "recommended", "alternatives",
    ),
    "Comparison": (
        "-vs-", "vs", "compare", "comparison", "alternative", "alternatives", "competitor",
        "competitors", "difference-between",
    ),
    "Partner / Integration": (
        "/partner", "/partners", "/integration", "/integrations", "/apps/", "/marketplace/",
        "/solutions/", "/technology-partners",
    ),
    "Profile Page": ("/author/", "/user/", "/profile/", "/member/", "/account/", "/contributors/", "/team/"),
    "Forum Thread": (
        "/forum/", "/thread/", "/topic/", "/discussion/", "/question/", "/answers/", "/community/",
    ),
    "Blog Article": ("/blog/", "/news/", "/article/", "/post/", "/insights/", "/stories/", "/updates/"),
    "Review Page": (
        "/review/", "/reviews/", "/rating/", "/testimonial/", "/customer-story/", "/case-study/",
    ),
    "Coupon": ("/coupon/", "/coupons/", "/discount/", "/promo/", "/deal/", "/offers/"),
    "Directory Listing": (
        "/directory/", "/listing/", "/companies/", "/vendors/", "/suppliers/", "/software/", "/products/",
    ),
}

DEFAULT_TYPE_V1 = "General / Blog (常规博客/其他)"

# --- actions of the first queue: first key found in the link type wins (fixed values) -------------------

ACTIONS_V1 = (
    (("App Market",), "技术/产品部：研发并上架对应平台的 App/插件"),
    (("Social / Video",), "社媒运营：注册官方账号留链接，或联系博主商单带货"),
    (("Directory / Review",), "基础运营：无需沟通，直接认领企业主页并刷几条好评"),
    (("Business Directory",), "基础运营：提交企业基础信息(NAP: 名字/地址/网址)"),
    (("Forum", "Thread"), "社媒运营：注册账号，养号并参与问答(带外链)"),
    (("Ecommerce",), "商务部：注册卖家/供应商账号，或寻求分销合作"),
    (("Coupon",), "联盟营销：提交 {brand} 独家折扣码给平台编辑"),
    (("News Media",), "PR/公关部：撰写高质量新闻稿，联系记者或通过PR平台分发"),
    (("Education",), "市场部：提供针对学生的专属方案，或提交教学案例获取 .edu 链接"),
    (("Affiliate", "Comparison", "Review"), "联盟营销：联系站长提议加入 {brand} 联盟计划(CPS)并请求测评"),
    (("Guest Post",), "内容SEO：按对方指南(Guidelines)撰写高质量行业文章投稿"),
    (("Resource Page",), "内容SEO：邮件联系编辑，请求将 {brand} 加入该资源库"),
    (("Listicle",), "内容SEO：邮件联系作者，请求将 {brand} 补充进入 Top 榜单"),
    (("Partner",), "BD/商务部：联系对方 Partner 团队，探讨 API 集成或联合营销"),
    (("Profile",), "基础运营：注册免费账户，在个人 Bio/主页留下外链"),
    (("Directory Listing",), "基础运营：提交工具/企业信息入驻该黄页目录"),
)
DEFAULT_ACTION_V1 = "获取邮箱并发送破冰 Pitch 邮件"

PRIORITIES_V1 = (
    (80, "P0 (核心狙击)"),
    (60, "P1 (重点跟进)"),
    (40, "P2 (日常铺垫)"),
)
PRIORITY_TAIL_V1 = "P3 (长尾观察)"
PRIORITY_SPAM_V1 = "🗑️ SPAM (直接放弃)"

# --- link type, second rule set (fixed values) --------------------------------------------------------

LINK_TYPES_V2 = {
    "App Marketplace": (
        "apps.shopify.com", "appstore.com", "apps.apple.com", "play.google.com", "wordpress.org/plugins",
        "woocommerce.com/products", "marketplace.visualstudio.com", "chrome.google.com/webstore",
        "addons.mozilla.org", "apps.microsoft.com", "zapier.com/apps", "make.com/apps",
        "slack.com/apps", "salesforce.com/appexchange", "hubspot.com/marketplace", "storeleads.app",
        "appstacked.io",
    ),
    "Software Review Directory": (
        "g2.com", "capterra.com", "getapp.com", "softwareadvice.com", "trustradius.com", "saashub.com",
        "sourceforge.net", "producthunt.com", "alternativeto.net", "serchen.com", "financesonline.com",
    ),
    "Ecommerce Resource": (
        "ecommerce-platforms.com", "dropshipping.com", "dodropshipping.com", "dsers.com", "hypersku.com",
        "minea.com", "alidrop.co", "zikanalytics.com", "leelinesourcing.com",
    ),
    "Marketplace": (
        "amazon.com", "ebay.com", "etsy.com", "walmart.com", "aliexpress.com", "alibaba.com", "temu.com",
        "rakuten.com", "shopify.com", "bigcommerce.com",
    ),
    "Social Media": (
        "youtube.com", "youtu.be", "tiktok.com", "instagram.com", "facebook.com", "pinterest.com",
        "reddit.com", "linkedin.com", "twitter.com", "x.com", "threads.net", "medium.com", "dev.to",
    ),
    "Business Directory": (
        "yelp.com", "yellowpages.com", "bbb.org", "hotfrog.com", "foursquare.com", "manta.com",
        "kompass.com", "clutch.co", "goodfirms.co", "designrush.com",
    ),
    "Coupon Deal": ("coupon", "coupons", "discount", "deal", "deals", "promo", "voucher", "cashback"),
    "Media": (
        "forbes.com", "entrepreneur.com", "techcrunch.com", "venturebeat.com", "wired.com",
        "theverge.com", "businessinsider.com",
    ),
    "SEO Link Network": (
        "backlink", "directory", "linkfarm", "guestpost", "writeforus", "submitarticle", "articlehub",
    ),
}

URL_TYPES_V2 = {
    "Guest Post": (
        "write-for-us", "writeforus", "guest-post", "guestpost", "contribute", "submit-article",
        "submit-post", "author-guidelines",
    ),
    "Listicle": ("best-", "best/", "top-", "top10", "top-10", "recommended", "ranking", "alternatives"),
    "Comparison": ("vs", "-vs-", "compare", "comparison", "alternative", "competitor"),
    "Review": ("review", "reviews", "rating", "testimonial", "case-study"),
    "Resource": (
        "/resources/", "/resource/", "/library/", "/guide/", "/guides/", "/academy/", "/knowledge-base/",
        "/tools/",
    ),
    "App Detail": ("/app/", "/apps/", "/software/", "/product/"),
    "Directory Listing": ("/directory/", "/listing/", "/vendors/", "/suppliers/", "/companies/"),
    "Forum Thread": ("/forum/", "/thread/", "/topic/", "/discussion/", "/question/"),
    "Blog Article": ("/blog/", "/article/", "/post/", "/news/", "/insights/"),
}

ANCHOR_INTENTS = {
    "Commercial Intent": ("buy", "price", "pricing", "supplier", "vendor", "software"),
    "Comparison Intent": ("vs", "alternative", "compare", "comparison"),
    "Review Intent": ("review", "rating", "feedback"),
    "SEO Intent": ("guest post", "write for us", "submit"),
}

DEFAULT_TYPE_V2 = "General Blog"
UNKNOWN_ANCHOR = "Unknown"
BATCHABLE_TYPES = (
    "Social Media", "Business Directory", "Coupon Deal", "SEO Link Network", "Directory Listing", "Forum Thread",
)
TOP_TIER_TYPES = ("App Marketplace", "Ecommerce Resource", "Software Review Directory", "Media")
DOWNGRADE_SUFFIX = " (低权重降级)"

# tier -> (rank, label) (fixed values)
TIERS_V2 = {
    "A": (1, "🔴 A类 (核心狙击)"),
    "B": (2, "🟡 B类 (半自动)"),
    "C": (3, "🔵 C类 (全自动批量)"),
    "trash": (4, "🗑️ SPAM/废弃"),
}
# actions of the second queue (fixed values)
ACTIONS_V2 = {
    "trash": "无价值死站/Spam，直接放弃",
    "C_small": "【全自动/VA】长尾小站，尝试用工具群发评论或低成本触达",
    "C_batch": "【全自动/VA】天生批量型站点，交由兼职按SOP批量填表发水帖",
    "A_app": "【产品部】开发相关插件并上架该生态",
    "A_media": "【公关部】撰写高质量新闻稿寻求官方报道",
    "A_other": "【商务部】联系官方入驻、谈深度商务合作或请求测评",
    "B": "【外展运营】人工审阅价值，邮件套用模板群发请求客座投稿或资源位",
}

# --- anchors and link details of the vendor A queues (fixed values) -------------------------------------

ANCHOR_KEYS_QUEUE = ("Link anchor", "Anchor", "anchor")
ANCHOR_KEYS_MATRIX = ("Anchor", "anchor")
NO_ANCHOR = "无锚文本"
NO_ANCHOR_V1 = "无锚文本/图片链接"
UNREADABLE_ANCHOR = "未知"
DEFAULT_FORMAT = "Blog/Article"
DEFAULT_INDUSTRY = "General B2B"
NOT_STARTED = "未开始 (Not Started)"
HANDOFF_STATES_B = {"review": "待审阅", "status": "未开始"}
BRIEF_TEXT = (
    "你是一个资深的跨境电商 B2B 营销专家。现在我要向一个【渠道调性：{industry}，文章类型偏好：{format}】的权威网站投稿。"
    "该网站权重 DR 为 {rating}。我的核心关键词是【{keyword}】。请严格根据以上特征，生成一篇字数2000字，带有对比表格，"
    "适合该渠道发布的专业文章初稿。"
)

# --- keyword queue and tasks (fixed values) ------------------------------------------------------------

KEYWORD_PRIORITIES = (
    (80, "P0 (核心狙击, 立刻写)"),
    (65, "P1 (重点排期, 必写)"),
    (50, "P2 (常规矩阵, 占坑)"),
    (30, "P3 (长尾观察, 随缘)"),
)
KEYWORD_PRIORITY_LAST = "🗑️ (难度太高或没流量，放弃)"
KEYWORD_ACTION_BUYING = "撰写高转化落地页(Landing Page) / 评测导购(Listicle/Comparison)"
KEYWORD_ACTION_INFORMATION = "撰写深度指南(How-to Guide) / 行业知识百科吸引长尾流量"
KEYWORD_ACTION_DEFAULT = "常规博客占坑，埋入内链引导至核心页面"

# page kind -> (page type, department, instruction, folder of the target URL) (fixed values)
PAGE_PLANS = {
    "integration": (
        "平台集成页 (Integrations)", "技术+内容",
        "必须强调 API 对接、一键抓取订单等技术硬实力，底本使用 SSR 渲染。", "/integrations/",
    ),
    "hub": (
        "垂直品类聚合页 (Niche Hubs)", "技术+内容",
        "必须采用 SSR (服务端渲染) 在列表底部增加 800 字类目描述与 FAQ。中间调用 {brand} 前 10 名热销 SKU，附带价格与利润率对比。",
        "/category/",
    ),
    "tool": (
        "免费工具页 (Free Tools)", "技术部",
        "前端开发 JS 轻量级小工具单页，用于吸引自然外链 (Backlinks)。页面保持极简，侧边加注册按钮。", "/tools/",
    ),
    "blog": (
        "痛点答疑博客 (Educational Blog)", "内容部",
        "撰写 1500 字以上深度长文，分点阐述。页面滚动至 40% 处触发悬浮注册 CTA，文章需埋设 2-3 个内链。", "/blog/",
    ),
}
INTEGRATION_WORDS = ("login", "app")
HUB_WORDS = ("dropshipping suppliers",)
TOOL_WORDS = ("calculator", "converter", "generator")
TITLE_SUFFIX = "(2026 Guide & Top Suppliers)"

# --- page classes (fixed values) -------------------------------------------------------------------------

PAGE_CLASSES = {
    "Blog & Content": ("blog", "article", "news", "guides", "learn"),
    "Product Features": ("features", "product", "tour"),
    "Free Tools (Engine)": ("tools", "calculators", "generator"),
    "Pricing": ("pricing", "plans"),
    "Glossary (Programmatic)": ("glossary", "dictionary", "wiki"),
    "Integrations Ecosystem": ("integrations", "apps", "plugins"),
    "Comparison Pages": ("vs", "compare", "alternatives"),
}
HOMEPAGE = "Homepage"

# --- acquisition path of the vendor B queue (fixed values) -------------------------------------------

CDN_HOSTS = (
    "cloudfront.net", "akamaized.net", "akamaihd.net", "cdn.jsdelivr.net", "googleusercontent.com",
    "gstatic.com", "gravatar.com", "imgur.com", "imageshack.com", "twimg.com", "fbcdn.net",
    "doubleclick.net",
)
REDIRECT_HOSTS = (
    "bit.ly", "t.co", "tinyurl.com", "goo.gl", "ow.ly", "buff.ly", "lnkd.in", "rebrand.ly", "cutt.ly",
    "shorturl.at",
)
TECHNICAL_PATHS = (
    "/wp-content/uploads/", "/wp-includes/", "/static/", "/assets/", "/cdn-cgi/", "/images/", "/image/",
    "/img/", "/fonts/", "/scripts/",
)
ASSET_EXTENSIONS = (
    "jpg", "jpeg", "png", "gif", "webp", "svg", "ico", "css", "js", "woff", "woff2", "ttf", "eot", "mp3",
    "mp4", "webm", "avi", "mov", "zip", "rar", "7z",
)
SELF_SERVE = (
    "add-listing", "add_listing", "addlisting", "add-company", "add-business", "add-site", "add-website",
    "submit-site", "submit-website", "submit-company", "submit-business", "submit-software",
    "submit-tool", "submit-product", "claim-profile", "claim-listing", "create-listing",
    "create-profile", "list-your-business", "list-your-company", "list-your-site", "get-listed",
    "add supplier", "add vendor", "submit supplier", "submit vendor",
)
DIRECTORY_PATHS = (
    "/directory/", "/directories/", "/listing/", "/listings/", "/companies/", "/company/", "/suppliers/",
    "/supplier/", "/vendors/", "/vendor/", "/businesses/", "/profiles/", "/profile/", "/software/",
    "/tools/",
)
DIRECTORY_DOMAINS = (
    "directory", "listings", "yellowpages", "hotfrog", "manta", "kompass", "capterra", "g2.com", "getapp",
    "trustradius", "saashub", "sourceforge", "producthunt", "alternativeto", "goodfirms", "clutch.co",
    "designrush",
)
OFFICIAL_ENTRY = (
    "contact", "contact-us", "contactus", "partner", "partners", "partnership", "become-a-partner",
    "partner-application", "vendor-application", "supplier-application", "apply", "application",
    "affiliate", "affiliates", "write-for-us", "writeforus", "guest-post", "guestpost", "contribute",
    "contributor", "submit-article", "submit-post", "editorial-guidelines", "submission-guidelines",
    "advertise", "advertising", "sponsor", "sponsorship", "media-kit", "press-contact",
    "resource-submission", "suggest-a-tool",
)
STRATEGIC = (
    "/integrations/", "/integration/", "integration-partner", "technology-partner", "developer",
    "developers", "api-partner", "app-marketplace", "marketplace/app", "marketplace/apps", "app-store",
    "plugin-directory", "extensions", "association", "membership", "member-directory",
    "research-partner", "data-partner", "press-room", "newsroom",
)
APP_DOMAINS = (
    "apps.shopify.com", "zapier.com", "make.com", "slack.com", "hubspot.com", "salesforce.com",
    "wordpress.org", "woocommerce.com", "microsoft.com", "chromewebstore.google.com",
    "addons.mozilla.org",
)
MEDIA_DOMAINS = (
    "forbes.com", "techcrunch.com", "entrepreneur.com", "businessinsider.com", "wired.com",
    "theverge.com", "venturebeat.com", "fastcompany.com", "inc.com", "reuters.com", "bloomberg.com",
)
EDITORIAL = (
    "/blog/", "/blogs/", "/article/", "/articles/", "/post/", "/posts/", "/news/", "/guide/", "/guides/",
    "/resources/", "/resource/", "/academy/", "best-", "top-", "review", "reviews", "comparison",
    "compare", "vs-", "alternatives", "recommended", "how-to", "case-study",
)
STRATEGIC_TLD = r"\.(edu|gov)(\.[a-z]{2})?$"

DROP_REASONS = {
    "self": "来源域名=竞品自身域名（非外部机会）",
    "redirect": "短链/跳转域名",
    "cdn": "CDN/静态资源托管域名",
    "assets": "全部样例都是图片/脚本/字体/压缩包等静态文件",
    "technical": "全部样例均位于静态资源路径",
}
EVIDENCE = {
    "app": "生态/App Marketplace 域名",
    "tld": "EDU/GOV 高门槛来源",
    "media": "头部媒体域名",
    "strategic": "战略关键词: ",
    "self_serve": "强 P0 信号: ",
    "directory": "目录/Profile 路径: ",
    "directory_domain": "目录型域名指纹: ",
    "official": "官方入口信号: ",
    "editorial": "内容型来源: ",
    "none": "未发现明确 P0/P1/P3 指纹，保守归入 P2 待核验",
}
EVIDENCE_JOIN = "；"

# path -> (priority, method, action) (fixed values)
PATHS = {
    "drop": ("Drop", "放弃：技术/结构性不可执行", "不投入人工外联；保留作审计证据。如误判可人工改回 P0-P3。"),
    "strategic": (
        "P3", "战略合作 / Integration / PR / 生态入驻",
        "先研究真实合作机制；需要定制资产、集成、PR、研究数据或高层商务，不按普通冷邮件批量做。",
    ),
    "self_serve": (
        "P0", "Self-serve 提交 / 注册 / Claim / Add Listing",
        "优先立即打开官方入口，注册账号并提交 {brand} 公司/产品/供应商主页；完成后记录 Live URL。",
    ),
    "directory": (
        "P0", "疑似 Self-serve Directory/Profile",
        "先查 Add Listing / Submit / Register / Claim Profile。若无自助入口，再降到 P1 官方 Contact。",
    ),
    "official": (
        "P1", "官方 Contact / Application / Partner / Contributor",
        "优先使用官方申请页/Contact Form/Partner Program；只有找不到官方入口时才转 P2 冷邮件。",
    ),
    "editorial": (
        "P2", "冷邮件：编辑更新 / Resource / Guest Post / Listicle",
        "定位站点编辑/内容负责人，优先针对现有文章或资源页提出具体更新理由，而不是泛化群发。",
    ),
    "unverified": (
        "P2", "冷邮件：需先人工核验获取机制",
        "默认进入人工/AI核验：找官方提交入口；若不存在，则寻找编辑/商务邮箱进行个性化冷外联。",
    ),
}
PATH_CONFIDENCE = {
    "drop": 0.98, "strategic_domain": 0.88, "strategic_words": 0.76, "self_serve": 0.94, "directory": 0.72,
    "official": 0.83, "editorial": 0.74, "unverified": 0.55,
}
PRIORITY_LABELS = {
    "P0": "P0｜马上执行：自助提交/注册/主页/Listing",
    "P1": "P1｜官方入口：Contact/Application/Partner",
    "P2": "P2｜冷邮件：编辑/资源页/文章更新/Guest Post",
    "P3": "P3｜战略型：Integration/Media/PR/生态合作",
    "Drop": "Drop｜技术残留/跳转/静态资源/不可执行",
}
PRIORITY_RANKS = {"P0": 0, "P1": 1, "P2": 2, "P3": 3, "Drop": 4}
ENRICHMENT_FULL = "已补充"
ENRICHMENT_PARTIAL = "部分补充"
ENRICHMENT_NONE = "未补充"
HIGH_PAGE_AUTHORITY = 40

# --- diagnostic levels: (exclusive upper bound, level) from low to high, then the level above (fixed) ---

LOSS_LEVELS = (((0.10, "较低"), (0.25, "正常"), (0.40, "偏高")), "很高")
FOLLOW_LEVELS = (((0.50, "较低"), (0.75, "中等")), "较高")
SITEWIDE_LEVELS = (((0.05, "很低"), (0.20, "中等")), "较高")
AUTHORITY_LEVELS = (((0.05, "偏低"), (0.20, "一般")), "较强")
CONCENTRATION_LEVELS = (((2, "非常分散"), (5, "较分散"), (15, "中等集中")), "高度集中")

# --- vendor B export columns and enrichment headers (fixed values) --------------------------------------

LINK_EXPORT_REQUIRED = ("source url", "target url")
LINK_EXPORT_RECOMMENDED = (
    "page ascore", "source title", "anchor", "external links", "internal links", "nofollow", "sponsored",
    "ugc", "text", "frame", "form", "image", "sitewide", "first seen", "last seen", "new link",
    "lost link",
)
DOMAIN_HEADERS = ("domain", "root domain", "url", "target", "website", "host", "host name", "hostname")
AUTHORITY_HEADERS = ("authority score", "as", "domain authority score", "authority")
VISITS_HEADERS = ("monthly visits", "visits", "monthly visit", "total visits")
TRAFFIC_HEADERS = ("organic traffic", "organic search traffic", "search traffic", "organic traffic estimate")
KEYWORDS_HEADERS = ("organic keywords", "keywords", "organic keyword")
LINK_FACT_COLUMNS = (
    "competitor_domain", "ref_domain", "source_title", "source_url", "target_url", "anchor", "page_ascore",
    "external_links", "is_nofollow", "is_sponsored", "is_ugc", "is_sitewide", "is_lost", "first_seen",
    "last_seen",
)

# --- mail merge: names of a prospect list without header (fixed values) -----------------------------------

PROSPECT_COLUMNS = (
    "目标域名 (Domain)", "分层与优先级 (Tier)", "🤖机器评分 (Auto Score)", "内容类型 (Link Type)",
    "建议策略 (Action Suggested)", "竞品重合度 (Alpha)", "🔗该域名下总外链 (Total Links)", "DR权重",
    "页面流量", "Dofollow", "Spam", "对标链接样例", "🧠AI：业务相关性评分 (0-100)",
    "🧠AI：配套内容 (如 Pitch 邮件|大纲)", "🧠AI：难度评级 (Easy|Hard)", "🧑‍💻联系邮箱 (Email)",
    "🧑‍💻获取入口URL", "🏆总分 (Total Score)（自动计算）", "🧑‍💻人工：审阅状态", "🧑‍💻当前状态 (Status)",
    "Last Action Date", "Link Result", "🤝合作模式 (Cooperation Model)", "💰合作报价 (Cost/Price)",
    "✍️内容提供方 (Content Provider)", "📍发布板块与位置 (Placement)", "⏳链接留存期 (Link Duration)",
    "🔗约定链接属性 (Agreed Attribute)", "身份",
)
EXTRA_PROSPECT_COLUMN = "未知扩展列_{index}"
