"""The labelled table of the HTML block classifier: small invented pages.

Elements with the attribute ``data-main`` hold main text; all other text is surroundings. The pages
cover what tells the two apart: named and unnamed containers, short and long blocks on either side,
link lists inside and outside an article, notices, adverts, forms and reader comments.
"""

from __future__ import annotations

LONG = ("The council met on Tuesday evening to discuss the new bridge, and after three hours of debate the members "
        "agreed to fund a first study of the river bed. Work could begin next spring if the money is found in time.")
MIDDLE = "Most shops along the street will stay open while the pipes are replaced during the summer."
SHORT = "A second vote follows in May."
LINKS = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("Home", "News", "Sport", "Weather", "About us"))
TEASERS = "".join(f'<p><a href="/{i}">{w}</a></p>' for i, w in enumerate(
    ("Ten quiet gardens to visit this year", "How the old harbour got its name", "Market prices rise again")))

# parts that pages with a named container are made of
BODIES = [
    f"<h1>Bridge study</h1><p>{LONG}</p><p>{SHORT}</p><p>Indeed.</p><p>{MIDDLE}</p>",
    "<p>Yes.</p><p>No.</p>",
    f"<h2>Pipes</h2><p>{MIDDLE}</p><p>So it goes.</p>",
    f"<p>{LONG}</p><p><a href='/report'>The full report of the committee</a></p><p>{MIDDLE}</p>",
    f"<h1><a href='/self'>A walk along the river</a></h1><p>{LONG}</p><ul><li>Bread</li><li>Cheese and milk</li></ul>",
    f"{LONG}",
    f"<p>{MIDDLE}</p><p><a href='/report'>Read the full report</a></p>",
    f"<h1>Harbour</h1><p>See <a href='/x'>the map of the harbour</a> first.</p><blockquote>{SHORT}</blockquote><p>{LONG}</p>",
]
CONTAINERS = [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="post-content">', "</div>")]
BEFORE = ["", f"<nav><ul>{LINKS}</ul></nav>", f"<p>{LONG}</p>", f'<div class="ad">{MIDDLE}</div>', f"<header><p>The Daily Page</p><p>{SHORT}</p></header>",
          f"<ul>{LINKS}</ul>", "<div>Edition of Monday</div>", f'<div class="cookie-banner"><p>{LONG}</p><button>Accept</button></div>']
INSIDE = ["", f'<div class="comments"><p>{LONG}</p><p>I agree.</p><form><label>Name</label><button>Send</button></form></div>', "",
          f"<ul>{LINKS}</ul>", "", f'<div class="advert">{SHORT}</div>', f'<div class="share"><a href="#">Share</a> <a href="#">Print</a></div>',
          f'<div class="related">{TEASERS}</div>', "", f"{TEASERS}", ""]
AFTER = ["", f"<footer>&copy; The Daily Page. {SHORT}</footer>", f"<p>{MIDDLE}</p>", f"<aside><h2>Elsewhere</h2><p>{LONG}</p>{TEASERS}</aside>",
         "<div>Page 3</div>", f'<section id="comments"><h3>Comments</h3><p>{LONG}</p></section>', "", f"<div>{LONG}</div><p>Imprint</p>",
         f'<div class="newsletter"><p>{MIDDLE}</p></div>', f"<ul>{LINKS}</ul>", f"<h2>More</h2><p>{LONG}</p><p>{MIDDLE}</p>",
         '<p><a href="/a">Older posts in the archive</a></p>', ""]


def named_page(i: int) -> str:
    """Page ``i`` of the pages with a named container; the parts' numbers share no divisor, so they mix."""
    begin, end = CONTAINERS[i % len(CONTAINERS)]
    return (f"<body>{BEFORE[i % len(BEFORE)]}{begin}<div data-main>{BODIES[i % len(BODIES)]}</div>{INSIDE[i % len(INSIDE)]}{end}"
            f"{AFTER[i % len(AFTER)]}</body>")


# no container is named: word counts and link densities decide
UNNAMED_PAGES = [
    f"""<body><div><a href="/">Home</a> | <a href="/n">News</a> | <a href="/c">Contact</a></div><div data-main><h1>The old mill</h1>
    <p>{LONG}</p><p>{MIDDLE}</p><p>{SHORT}</p><p>{LONG}</p></div><div>All rights reserved</div></body>""",
    f"""<body><table><tr><td><a href="/">Start</a></td><td><a href="/k">Archive</a></td></tr></table><p data-main>{LONG}</p>
    <p data-main>{MIDDLE}</p><p data-main>{LONG}</p><p><a href="/a">Older posts in the archive</a></p><p>Page 3</p></body>""",
    f"""<body><ul>{LINKS}</ul><p data-main>{MIDDLE}</p><p data-main>{MIDDLE}</p>{TEASERS}<div><a href="/i">Imprint</a></div></body>""",
    f"""<body><p><a href="/">Back</a></p><h2 data-main>Three bridges</h2><p data-main>{LONG}</p><p data-main>Then silence.</p>
    <p data-main>{LONG}</p><p>Last change: Monday</p></body>""",
    f"<body><p data-main>{LONG}</p><p data-main>{SHORT}</p><p data-main>{MIDDLE}</p></body>",
    f"<body><p data-main>{MIDDLE}</p></body>",
    f"<body><h1 data-main>Lamps</h1><p data-main>{LONG}</p><div class='ad'>{MIDDLE}</div><p data-main>{LONG}</p></body>",
    f"<body><nav>{LINKS}</nav><p data-main>{LONG}</p><p data-main>{SHORT}</p><footer>{MIDDLE}</footer></body>",
    # nothing but surroundings
    f"""<body><nav>{LINKS}</nav><div class="notice"><p>{LONG}</p></div><p>Loading</p><footer><p>{MIDDLE}</p></footer></body>""",
    f"""<body><form><p>{MIDDLE}</p><label>Your mail</label><button>Sign in</button></form><div><a href="/h">Help</a></div></body>""",
    "<body><p>Not found</p><p><a href='/'>Back to the start page</a></p></body>",
    f"<body><ul>{LINKS}</ul>{TEASERS}</body>",
]

LABELLED_PAGES = [named_page(i) for i in range(90)] + UNNAMED_PAGES
