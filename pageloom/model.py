"""Roles, profiles, statuses and word lists of the engine, and the Spark types of its rows."""

from __future__ import annotations

# Block roles in the order of their stored numbers.
ROLES = (
    "Unknown MainContent Article Heading Summary PrimaryNavigation SecondaryNavigation Breadcrumb Sidebar RelatedLinks Footer Header "
    "Advertisement CookieBanner Form Table CodeBlock Boilerplate RepeatedItem Title"
).split()
ROLE_NUMBER = {r: i for i, r in enumerate(ROLES)}

_CONTENT = "MainContent Article Title Heading Summary Table CodeBlock RepeatedItem".split()
# Which roles each profile prints.
PROFILES = {
    "MainContentOnly": frozenset(_CONTENT),
    "Wcxb": frozenset(_CONTENT),
    "RagFull": frozenset(ROLES) - frozenset("Footer Header Advertisement CookieBanner Boilerplate Unknown PrimaryNavigation SecondaryNavigation".split()),
    "AgentNavigation": frozenset("Title PrimaryNavigation SecondaryNavigation Breadcrumb Form".split()),
    "Sitemap": frozenset("Title Heading PrimaryNavigation SecondaryNavigation Breadcrumb".split()),
    "DebugFull": frozenset(ROLES),
}
STATUSES = "FastPathHit SlowPathMatch Novel NovelEphemeral Refit OperatorOverride".split()

# Class and id hints, matched as substrings without case.
NAV_HINTS = "nav navigation menu navbar main-menu site-nav".split()
AD_HINTS = "ad ads advertisement promo sponsored".split()
CONTENT_HINTS = "content article post main entry".split()
CHROME_HINTS = "ad advertisement sidebar nav menu footer header widget comments".split()
FOOTER_PHRASES = ["all rights reserved", "privacy policy", "terms of service", "terms & conditions", "cookie policy"]
COOKIE_PHRASES = ["we use cookies", "this site uses cookies", "accept all cookies", "manage cookie preferences"]
COPYRIGHT = [r"©\s*\d{4}", r"copyright\s+\d{4}", r"\(c\)\s*\d{4}"]
FRAMEWORK_HINTS = (
    "entry-content post-content the-content wp-block-post-content post-body entry-body article-body article-content post-article gh-content "
    "kg-content post-full-content field--name-body node__content field--type-text-with-summary magento-content-area product-info-description "
    "gutenberg-content story-body story-content rich-text-content main-content primary-content page-content content-body blog-post-content "
    "blog-content cooked topic-body topic-area single-post-content block_content category-products products-list woocommerce-product-details "
    "single-product-content product__description product-single__description productView-description sqs-block-content sqs-block-markdown "
    "markdown-body postbody postcontent item-page w-richtext wixui-text"
).split()
CONTAMINATION_HINTS = (
    "nav menu breadcrumb toc table-of-contents toolbar action-bar actions page-actions sidebar mw-jump-link headerlink edit-page navigation "
    "skip-link skip-main mw-editsection mw-references-wrap siteSub jump-to-nav catlinks printfooter mw-indicators content-header article-header "
    "page-header doc-header feedback edit-this-page share suggest-change ai-summary article-metadata notification-info add-to-cart add-to-bag "
    "add-to-wishlist add-to-list wishlist quick-shop quick-view shop-now buy-now buy-button related-products related-items related-articles "
    "you-may-also-like ymal recently-viewed recommended-for-you people-also-bought people-also-viewed customers-also-bought "
    "customers-also-viewed recommendations recommended-products product-card product-grid product-list product-tile filter-bar filter-and-sort "
    "sort-and-filter sort-bar pickup-in-store pick-up-in-store store-locator newsletter-signup newsletter-form subscribe-form cross-sell upsell"
).split()
SEGMENT_TAGS = frozenset("header footer nav main article section aside form table".split())
# The tags a byte-level filter lets through.
STRUCTURAL_TAGS = "html body head header footer nav aside section article main div p ul ol li h1 h2 h3 h4 h5 h6 table tbody thead tr".split()
CLEAN_TAGS = frozenset("script style template noscript svg select".split())
NOISE_TOKENS = frozenset("dark-mode light-mode dark light active hidden visible selected open closed loading loaded error".split())
NOISE_PREFIXES = ("is-", "js-", "has-", "data-", "state-", "aria-")
NOISE_SUFFIX = r"__[a-z0-9]{4,}$"
REPEAT_SKIP_CONTAINER = frozenset(
    "table tbody thead tfoot tr head html body header footer nav aside article main section dd dt li p span blockquote".split()
)
REPEAT_SKIP_CHILD = frozenset("p ul ol dl li dt dd span td th blockquote h1 h2 h3 h4 h5 h6 pre code section".split())
REPEAT_SKIP_ANCESTOR = frozenset("article footer header nav aside form".split())
REPEAT_SELF_TYPED = frozenset("article section li".split())
TEXT_INPUTS = frozenset("text email search tel url number password date datetime-local month week time".split())

LINK_TYPE = "struct<text:string,href:string,is_external:boolean>"
BLOCK_FIELDS = f"ord int, role string, confidence double, text string, markdown string, xpath string, text_length int, link_density double, links array<{LINK_TYPE}>"
