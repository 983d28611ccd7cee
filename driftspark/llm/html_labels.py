"""Labelled pages for the extractor of main text: ``data-main`` marks what belongs to it (1) and what not (0)."""

_P = "It was late in the year when the first of the boats came back, and nobody in the town had thought to wait for them."
_Q = "The council met again on Tuesday. Its members, who had not agreed before, voted for the plan; two of them stayed away."
_S = "Not so."

PAGES = [
    f"<html><head><title>x</title></head><body><header class=masthead><a href=/>The Daily</a></header><nav><ul><li><a href=/a>News</a><li><a href=/b>Sport</a></ul></nav>"
    f"<article data-main=1><h1>Boats return</h1><p>{_P}</p><p>{_S}</p><p>{_Q}</p><p>{_P} {_Q}</p></article><footer>&copy; 2024 The Daily. All rights reserved.</footer></body></html>",
    f"<body><div id=header><div class=logo>Home</div><div class=menu><a href=/1>One</a> <a href=/2>Two</a></div></div><div class='post content' data-main=1><h2>A plan</h2><p>{_Q}"
    f"<p>{_P}<ul><li>first of all the boats</li><li>then the town</li></ul><p>{_S}</div><div class=sidebar><h3>Popular</h3><ul><li><a href=/x>{_S}</a></li><li><a href=/y>Boats</a></li></ul></div><div id=footer>Contact | Imprint</div></body>",
    f"<body><nav class=breadcrumbs><a href=/>Home</a> &gt; <a href=/t>Town</a></nav><div class=ad>{_Q}</div><main data-main=1><h1>Town</h1><p>{_S}</p><p>{_P}</p><blockquote>{_Q}</blockquote><p>{_P}</p>"
    f"<section class=comments data-main=0><h3>Comments</h3><div class=comment><p>{_P}</p></div><div class=comment><p>{_Q}</p></div><form><p>Your name</p><button>Send</button></form></section></main><footer><p>{_P}</p></footer></body>",
    f"<body><div class='cookie-notice'><p>{_Q}</p><button>Accept</button></div><article data-main=1><header data-main=0><p>By A. Writer</p></header><h1>Short</h1><p>{_S}</p><aside data-main=0><p>{_P}</p><a href=/r>Read more</a></aside>"
    f"<p>{_P}</p><div class=ad data-main=0><p>{_Q}</p></div><p>{_Q}</p><figure><figcaption>Boats in the harbour, {_S}</figcaption></figure><p>{_S}</p></article><aside><p>{_Q}</p></aside><footer>{_S}</footer></body>",
    f"<body><div role=banner>The Site</div><div role=navigation><a href=/1>A</a><a href=/2>B</a></div><div role=main data-main=1><p>{_P}</p><p>{_P}</p><table><tr><td>boats</td><td>12</td></tr><tr><td>crew</td><td>48</td></tr></table><p>{_Q}</p></div>"
    f"<div role=complementary><p>{_P}</p></div><div role=contentinfo>{_Q}</div></body>",
    f"<body><nav><ul><li><a href=/a>{_S}</a></li></ul></nav><div class=ad>{_P}</div><article data-main=1><h1>{_S}</h1><p>{_S}</p></article><footer>&copy; site &middot; {_Q}</footer></body>",
    f"<body><nav><ul><li><a href=/a>of</a></li><li><a href=/b>the</a></li></ul></nav><div class=ad>{_S}</div><article data-main=1><h1>{_Q}</h1><p><b>{_Q}<br><p>{_P}</p><p>{_S}</p><p>a</p></article><footer>{_P}</footer></body>",
    f"<body><form><p>Search this site</p><input name=q></form><article data-main=1><p>{_P}</p><h2>Then</h2><p>{_Q}</p><ol><li>{_S}</li><li>{_P}</li></ol><pre>a = b</pre><p>{_S}</p></article><div id=comments><h2>2 replies</h2><p>{_P}</p><p>{_Q}</p></div></body>",
    f"<body><div class=newsletter><h3>Subscribe</h3><p>{_P}</p></div><section id=content data-main=1><h1>Boats</h1><p>{_Q}</p><p>{_P}</p><div class=related data-main=0><h4>Related</h4><ul><li><a href=/q>{_Q}</a></li></ul></div><p>{_P}</p></section><div class=copyright>{_S}</div></body>",
    f"<body><header><h1>The Daily</h1><p>{_Q}</p></header><article data-main=1><h1>Two</h1><p>{_P}</p><p><a href=/z>{_P}</a></p><p>{_Q}</p><div class=share data-main=0><a href=/f>Share</a></div><section class=replies data-main=0><p>{_Q}</p><p>{_P}</p></section></article><footer><ul><li><a href=/i>Imprint</a></li></ul></footer></body>",
    f"<body><div class=alert>{_P}</div><div class=entry data-main=1><p>{_P}</p><p>{_P}</p><p>{_S}</p></div><div class=widget><p>{_P}</p></div><div class=sponsored><p>{_Q}</p><p>{_P}</p></div></body>",
    f"<body><p>Home</p><div><p data-main=1>{_P} {_Q}</p><p data-main=1>{_Q} {_P}</p><p data-main=1>{_P} {_P}</p></div><p><a href=/>Back</a></p></body>",
    f"<body><article data-main=1><h1>All</h1><p>{_P}</p><form data-main=0><p>{_Q}</p><p>Vote</p></form><p>{_Q}</p><nav data-main=0><a href=/2>Next page</a></nav></article></body>",
    f"<body><article data-main=1><h1>Tides</h1><p>{_Q}</p><p hidden data-main=0>{_P}</p><p>{_P}</p><div style='display:none' data-main=0><p>{_Q}</p></div></article><dialog><p>{_P}</p></dialog><menu><li>Cut<li>Copy</menu></body>",
    f"<body><nav><a href=/1>{_Q}</a></nav><aside class=notice><p>{_P}</p></aside><footer>{_P}</footer></body>",
]
