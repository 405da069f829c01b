"""Pages of different layouts, labelled by hand: (name, html, the blocks of the main text)."""

A = "The river rose overnight, and by morning the lower road was under water."
B = "Nobody in the valley had seen anything like it since the old mill burned down, people said."
C = "The council met twice that week. It agreed to raise the banks, though not on how to pay for them."
D = "By the end of the month most of the farms had dried out; the road took longer."
E = "In spring the work began at last."
R = "I live down there, and I must say that the council has known of this for years, as everybody can tell you."
S = "Thanks for this piece, it was good to read something about our valley for once."
MENU = "<ul><li><a href='/'>Home</a></li><li><a href='/news'>News</a></li><li><a href='/sport'>Sport</a></li><li><a href='/x'>Contact</a></li></ul>"
PROSE_AD = "Buy the new garden pump today, it is the best that money can buy, and it ships within two days."


def p(*texts):
    return "".join(f"<p>{t}</p>" for t in texts)


ALL = [A, B, C, D]
PAGES = [
    ("article and landmarks", f"<header><h2>Valley News</h2></header><nav>{MENU}</nav><article><h1>High water</h1>{p(*ALL)}</article>"
     "<footer>Printed in the valley.</footer>", ["High water", *ALL]),
    ("main only", f"<body><nav>{MENU}</nav><main><h1>High water</h1>{p(*ALL)}</main><footer><p>All rights reserved.</p></footer>",
     ["High water", *ALL]),
    ("no landmarks", f"<body><div>{MENU}</div><div><h1>High water</h1>{p(*ALL)}</div><div>{MENU}</div></body>", ["High water", *ALL]),
    ("names only", f"<div id='header'>Valley News</div><div class='navbar'>{MENU}</div><div class='post-content'>{p(*ALL)}</div>"
     f"<div id='footer'><p>{B}</p></div>", ALL),
    ("comments after the article", f"<article>{p(*ALL)}</article><section id='comments'><h2>Comments</h2>"
     f"<div class='comment'>{p(R)}</div><div class='comment'>{p(S)}</div></section>", ALL),
    ("comments inside the article", f"<article>{p(*ALL)}<section class='comments'><h3>2 replies</h3>{p(R, S)}</section></article>", ALL),
    ("comments as articles", f"<main>{p(*ALL)}<div class='comment-list'><article class='comment'>{p(R)}</article>"
     f"<article class='comment'>{p(S)}</article></div></main>", ALL),
    ("nested comment articles", f"<article>{p(*ALL)}<article class='comment'><header>Ann</header>{p(R)}</article></article>", ALL),
    ("comment list", f"<article>{p(*ALL)}</article><ol class='commentlist'><li class='comment' id='comment-17'>{R}</li>"
     f"<li class='comment'>{S}</li></ol>", ALL),
    ("post comments", f"<div class='entry'>{p(*ALL)}</div><div id='post-comments'>{p(R, S, R)}</div>", ALL),
    ("prose notice", f"<article><div class='notice'>{p('We have changed our terms, please read them with care before you go on.')}</div>{p(*ALL)}</article>", ALL),
    ("notice paragraph", f"<article><p class='notice'>This page was moved here from our old site, links may be broken.</p>{p(*ALL)}</article>", ALL),
    ("prose advert", f"<article>{p(A, B)}<div class='advert'>{p(PROSE_AD)}</div>{p(C, D)}</article>", ALL),
    ("advert slot", f"<article>{p(A, B)}<div class='ad-slot-2' id='ad-300x250'><p>{PROSE_AD}</p><p>{PROSE_AD}</p></div>{p(C, D)}</article>", ALL),
    ("sponsored box", f"<main>{p(A)}<aside class='sponsored'><h3>From our partners</h3>{p(PROSE_AD)}</aside>{p(B, C)}</main>", [A, B, C]),
    ("sidebar of prose", f"<div class='sidebar'><h3>About us</h3>{p('We are a small paper, and we have been here for a hundred years.', E)}</div>"
     f"<article>{p(*ALL)}</article>", ALL),
    ("teasers in a sidebar", f"<article>{p(*ALL)}</article><aside><article><h3>Old mill</h3>{p(S)}</article></aside>", ALL),
    ("wrapped by a sidebar layout", f"<div class='content-sidebar-wrap'><div>{MENU}</div><div><h1>High water</h1>{p(*ALL)}</div></div>",
     ["High water", *ALL]),
    ("state class on the body", f"<body class='has-sidebar no-comments'><div>{MENU}</div><div>{p(*ALL)}</div></body>", ALL),
    ("inline names", f"<article><p>The <span class='related'>river</span> rose <em class='comment'>overnight</em>, and by"
     f" <a class='share' href='/m'>morning</a> the lower road was under water.</p>{p(B, C)}</article>", [A, B, C]),
    ("inline hidden", f"<article><p>The river rose<span hidden> (secret)</span> overnight, and by morning the lower road was under"
     f" water.</p>{p(B)}</article>", [A, B]),
    ("hidden containers", f"<div style='display: none'>{p(R)}</div><div aria-hidden='true'>{p(S)}</div><article>{p(*ALL)}</article>", ALL),
    ("form in the article", f"<article>{p(A, B)}<form><label>Your mail</label><input name=m><button>Subscribe</button></form>{p(C)}</article>", [A, B, C]),
    ("form around the page", f"<form id='aspnetForm'><div>{MENU}</div><div class='article'><h1>High water</h1>{p(*ALL)}</div></form>",
     ["High water", *ALL]),
    ("headings with telling ids", f"<article><h1 id='notice'>High water</h1>{p(A, B)}<h2 id='related-work'>Related work</h2>{p(C, D)}"
     f"<h2 id='comments'>What people say</h2>{p(E)}</article>", ["High water", A, B, "Related work", C, D, "What people say", E]),
    ("header in the article", f"<article><header class='entry-header'><h1>High water</h1></header>{p(*ALL)}<footer>Filed under: news</footer></article>",
     ["High water", *ALL]),
    ("short paragraphs between long ones", f"<body><div>{MENU}</div><div>{p(A, B, 'It rained.', C, 'And then?', D)}</div><div>{MENU}</div></body>",
     [A, B, "It rained.", C, "And then?", D]),
    ("list in the text", f"<article>{p(A)}<ul><li>new banks</li><li>a wider bridge</li></ul>{p(B)}</article>",
     [A, "new banks", "a wider bridge", B]),
    ("cookie banner", f"<div class='cookie-consent'>{p('We use cookies to make this site better, and to show you adverts that you may like.')}</div>"
     f"<main>{p(*ALL)}</main>", ALL),
    ("breadcrumb and pagination", f"<article><div class='breadcrumbs'><a href='/'>Home</a> / <a href='/n'>News</a></div><h1>High water</h1>"
     f"{p(*ALL)}<div class='pagination'><a href='?2'>Next page</a></div></article>", ["High water", *ALL]),
    ("share buttons", f"<article>{p(A, B)}<div class='share'><a href='#'>Post</a> <a href='#'>Mail</a></div>{p(C)}</article>", [A, B, C]),
    ("link list without names", f"<body><ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul><h1>High water</h1>{p(*ALL)}"
     "<table><tr><td><a href=4>Four</a><td><a href=5>Five</a></table></body>", ["High water", *ALL]),
    ("table and quote", f"<article>{p(A)}<blockquote>{B}</blockquote><table><tr><td>Monday</td><td>2 m</td></tr></table>{p(C)}</article>",
     [A, B, "Monday", "2 m", C]),
    ("roles", f"<div role='banner'>Valley News</div><div role='navigation'>{MENU}</div><div role='main'>{p(*ALL)}</div>"
     f"<div role='complementary'>{p(R)}</div><div role='contentinfo'>{p(E)}</div>", ALL),
    ("newsletter box", f"<article>{p(A, B)}<div class='newsletter-box'><p>Get our letter each week, it is free and short, and you can leave it at any time.</p></div>"
     f"{p(C, D)}</article>", ALL),
    ("odd white space and references", "<article><p>The river\n rose&nbsp;overnight,\tand by morning the lower road was under&#32;water."
     f"<p>{B}</article>", [A, B]),
    ("plain lines between paragraphs", f"<body><div>{MENU}</div><div>{p(A, B)}<div>The lower road, seen from the mill.</div>{p(C, D)}</div></body>",
     [A, B, "The lower road, seen from the mill.", C, D]),
    ("a table cell of prose lines", f"<body><div>{MENU}</div><table><tr><td>{p(A)}<div>{B}</div>{p(C)}<div>{E}</div>{p(D)}</td></tr></table></body>",
     [A, B, C, E, D]),
    ("a stray paragraph in a menu", "<body><div><div><a href=1>Home</a></div><div><a href=2>News</a></div><p>Menu</p><div><a href=3>Sport</a></div>"
     f"<div><a href=4>Contact</a></div></div><div><div><div>{p(*ALL)}</div></div></div></body>", ALL),
]
