"""Hand-marked pages of the shapes that sites have: page builders, WordPress, tables, none with an article tag unless marked."""

import pytest

from courierlake.llm.html_blocks import main_text, standing

P1 = "The old mill by the river was sold to a family from the town, and it is said that they will open it to all who want to see how flour was made in the days of their fathers."
P2 = "In the spring the water is so high that the wheel turns day and night, but in the summer it stands still for weeks and the people of the village have to bring their corn to the next valley."
P3 = "It was not the first time that the mill had been for sale, and those who live near it hope that it will be the last."
WHOLE = f"{P1}\n{P2}"
T = f"The mill\n{WHOLE}"
NAV = "<nav><ul><li><a href=/>Home</a><li><a href=/news>News</a></ul></nav>"

PAGES = {
    "builder": (f'{NAV}<div class="elementor-section"><div class="elementor-widget-wrap"><div class="elementor-widget-container"><h1>The mill</h1></div><div class="elementor-widget-container"><p>{P1}</p></div><div class="elementor-widget-container"><p>{P2}</p></div></div></div><div class="site-footer">(c) us</div>', T),
    "builder in article": (f'<article><div class="elementor-widget-container"><h1>The mill</h1></div><div class="elementor-widget-container"><p>{P1}</p><p>{P2}</p></div></article><aside>x</aside>', T),
    "builder with a sidebar": (f'<div class="et_pb_widget_text"><h1>The mill</h1><p>{P1}</p><p>{P2}</p></div><div class="sidebar-right"><p>{P3}</p></div>', T),
    "named paragraph": (f'<div><h1>The mill</h1><p class="comment-on-law">{P1}</p><p class="search-for-meaning">{P2}</p></div><div class="comment-list"><p>{P3}</p></div>', T),
    "wordpress": (f'<div class="site-header"><a href=/>Our village</a></div><article class="post type-post"><header class="entry-header"><h1 class="entry-title">The mill</h1></header><div class="entry-content"><p>{P1}</p><p>{P2}</p></div><footer class="entry-footer">Posted in <a href=/c>News</a></footer></article><div id="comments" class="comments-area"><p>{P3}</p></div><div class="widget-area"><p>{P3}</p></div>', T),
    "title before": (f'<div class="page-header"><h1>The mill</h1></div><article><p>{P1}</p><p>{P2}</p></article><div class="related-posts"><p>{P3}</p></div>', T),
    "site name before": (f'<header class="site-header"><h1>Our village</h1></header><article><h1>The mill</h1><p>{P1}</p><p>{P2}</p></article>', T),
    "site name in a div": (f'<div class="header"><h1>Our village</h1></div><article><h2>The mill</h2><p>{P1}</p><p>{P2}</p></article>', T),
    "two headings before": (f"<h1>Our village</h1><h1>News</h1><article><h2>The mill</h2><p>{P1}</p><p>{P2}</p></article>", T),
    "bootstrap": (f'<div class="navbar navbar-default"><a href=/>Home</a></div><div class="container"><div class="row"><div class="col-md-8"><h1 class="page-header">The mill</h1><p>{P1}</p><p>{P2}</p></div><div class="col-md-4 sidebar"><p>{P3}</p></div></div></div>', T),
    "table": (f'<table><tr><td class="menu"><a href=/>Home</a></td><td><h1>The mill</h1><p>{P1}</p><p>{P2}</p></td></tr></table><div class="footer">(c)</div>', T),
    "layout of the site": (f'<div class="layout-with-sidebar has-banner"><div class="main-content"><h1>The mill</h1><p>{P1}</p><p>{P2}</p></div><div class="sidebar-left"><p>{P3}</p></div></div>', T),
    "comments of a plugin": (f'<main><h1>The mill</h1><p>{P1}</p><p>{P2}</p><div class="fb-comments"><p>{P3}</p></div><div id="disqus_thread"><p>x</p></div></main>', T),
    "cookie wall": (f'<div class="cookie-notice"><p>{P3}</p></div><div class="modal-overlay"><p>{P3}</p></div><div><h1>The mill</h1><p>{P1}</p><p>{P2}</p></div>', T),
    "newsletter inside": (f'<div class="content"><h1>The mill</h1><p>{P1}</p><div class="newsletter-signup"><p>{P3}</p></div><p>{P2}</p><div class="social-share-buttons"><a href=x>Share</a></div></div>', T),
    "adverts": (f'<div class="content"><h1>The mill</h1><p>{P1}</p><div class="ad-slot"><p>{P3}</p></div><p>{P2}</p><div class="ad-container-1">Buy</div></div>', T),
    "names of meaning": (f'<div class="story"><h1>The mill</h1><div class="notice-of-sale"><p>{P1}</p><p>{P2}</p></div></div>', T),
    "quote and list": (f'<div id="content"><h1>The mill</h1><p>{P1}</p><blockquote class="widget-quote-x">{P2}</blockquote><ul><li>Flour</li><li>Bran</li></ul></div><footer>(c)</footer>', f"{T}\nFlour\nBran"),
    "pager": (f'<div class="post"><h1>The mill</h1><p>{P1}</p><p>{P2}</p></div><div class="post-navigation"><a href=/2>Next story</a></div><div class="page-navigation">1 2 3</div>', T),
    "old form": (f'<form id="aspnetForm"><div class="topbar"><a href=/>Home</a></div><div id="ctl00_content"><h1>The mill</h1><p>{P1}</p><p>{P2}</p></div></form>', T),
    "doubtful and small": (f'<div><h1>The mill</h1><p>{P1}</p><p>{P2}</p></div><div class="weather-widget-x"><p>{P3}</p></div>', T),
}


@pytest.mark.parametrize("name", PAGES)
def test_marked_page(name):
    page, want = PAGES[name]
    assert main_text(f"<html><body>{page}</body></html>") == want


def test_names():
    for name in ("sidebar", "cookie-notice", "comment-list", "fb-comments", "site-footer", "ad_slot_3", "Main-Navigation"):
        assert standing(name) == (True, ()), name
    for name in ("entry-header", "article-title", "padding-left", "has-sidebar", "story"):
        assert standing(name) == (False, ()), name
    assert standing("elementor-widget-container x") == (False, ("elementor-widget-container",))
