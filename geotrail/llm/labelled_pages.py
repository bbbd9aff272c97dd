"""Labelled pages: hand-written layouts with their content marked.

Elements with the attribute data-main hold content, all others do not; the
attribute itself is never a feature. The layouts cover articles in semantic
and in plain markup, old table layouts, and the usual surroundings: menus,
headers, footers, sidebars, notices, adverts, forms and reader comments.
"""

_P = "A plain sentence of the story, as long as sentences in a body of text usually are."
_Q = "Another one follows, and it says a little more about what has happened since."
_S = "Short words here"

PAGES = (
    # semantic article
    f"""<html><head><title>Site</title></head><body><header><a href=/>{_S}</a><p>{_S}</p></header>
    <nav><ul><li><a href=/a>{_S}</a></li><li><a href=/b>{_S}</a></li><li>{_S}</li></ul></nav>
    <div class="ad">{_P}</div><article data-main><h1>{_S}</h1><p>{_P} {_Q}</p><p>{_Q} <a href=/x>{_S}</a> {_P}</p>
    <h2>{_S}</h2><p>{_P}</p><ul><li>{_Q}</li><li>{_P}</li></ul><blockquote>{_Q}</blockquote></article>
    <aside><h3>{_S}</h3><p>{_P}</p></aside><footer><p>{_P}</p><a href=/i>{_S}</a></footer></body></html>""",
    # comments and a form below the article, a notice above
    f"""<body><div class="cookie-notice" role="alert"><p>{_P} {_Q}</p><button>{_S}</button></div>
    <main><article data-main><header><h1>{_S}</h1></header><p>{_P}</p><p>{_Q} {_P}</p><p>{_Q}</p></article>
    <section id="comments" class="comments"><h2>{_S}</h2><div class="comment"><p>{_P} {_Q}</p></div>
    <article class="comment"><p>{_Q} {_P}</p></article></section>
    <form action=/c><label>{_S}</label><p>{_P}</p><textarea>{_P}</textarea><input type=submit></form></main>
    <footer>{_S} <a href=/p>{_S}</a></footer></body>""",
    # div layout with class names
    f"""<body><div id="header"><h2>{_S}</h2></div><div class="navbar menu"><a href=/a>{_S}</a> <a href=/b>{_S}</a></div>
    <div id="content" class="post-content" data-main><h1>{_S}</h1><div>{_P} {_Q}</div><div>{_Q}<br>{_P}</div>
    <p>{_P} <em>{_S}</em> {_Q}</p></div>
    <div id="sidebar"><div class="widget"><h3>{_S}</h3><p>{_P}</p><ul><li><a href=/r>{_S}</a></li></ul></div></div>
    <div class="share social"><a href=/f>{_S}</a></div><div id="footer"><p>{_Q}</p></div></body>""",
    # no class names at all
    f"""<body><ul><li><a href=/1>{_S}</a></li><li><a href=/2>{_S}</a></li></ul>
    <div data-main><h1>{_S}</h1><p>{_P}</p><p>{_Q} {_P}</p><p>{_P}</p><table><tr><td>{_P}</td><td>{_Q}</td></tr></table>
    </div><div><a href=/3>{_S}</a> | <a href=/4>{_S}</a></div></body>""",
    # table layout
    f"""<body><table><tr><td><a href=/1>{_S}</a><br><a href=/2>{_S}</a></td><td><div data-main><h1>{_S}</h1>
    <p>{_P} {_Q}</p><p>{_Q}</p></div></td></tr><tr><td><font>{_S}</font></td></tr></table></body>""",
    # boilerplate inside the article
    f"""<body><nav>{_S}</nav><article><div data-main><h1>{_S}</h1><p>{_P} {_Q}</p></div>
    <div class="advert"><p>{_P}</p></div><div data-main><p>{_Q}</p><p>{_P} {_Q}</p></div>
    <aside class="related"><p>{_P}</p><a href=/o>{_S}</a></aside><nav><a href=/t>{_S}</a></nav>
    <div class="newsletter subscribe"><p>{_Q}</p><form><input></form></div>
    <div data-main><p>{_P}</p></div><footer><p>{_S}</p></footer></article></body>""",
    # a short story under a long menu, notice and comments
    f"""<body><header><div class="banner">{_P}</div></header><div class="breadcrumbs"><a href=/>{_S}</a> {_S}</div>
    <section class="story-body" data-main><h1>{_S}</h1><p>{_Q}</p></section>
    <ol class="commentlist"><li><p>{_P} {_Q}</p></li><li><p>{_Q} {_P}</p></li></ol>
    <div class="notice">{_P}</div><footer><ul><li><a href=/a>{_S}</a></li></ul></footer></body>""",
    # running text straight in the body
    f"""<body><h1 data-main>{_S}</h1><p data-main>{_P} {_Q}</p><p data-main>{_Q}</p><hr>
    <div class="sponsored promo">{_Q}</div><p data-main>{_P}</p><address>{_S}</address></body>""",
    # sections named by their headings, and classes that hold a hint among other words
    f"""<body><header><a href=/>{_S}</a></header><article data-main><h1>{_S}</h1><p>{_P}</p><section id="related-work">
    <h2 id="related">{_S}</h2><p>{_P} {_Q}</p></section><div class="commercial-use"><p>{_Q}</p><p>{_P}</p></div>
    <section id="discussion"><h2>{_S}</h2><p>{_Q} {_P}</p><ul><li>{_Q}</li></ul></section></article>
    <div class="related-posts"><p>{_P}</p></div><footer><p>{_Q}</p></footer></body>""",
    # the same without an article
    f"""<body><div class="menu"><a href=/>{_S}</a></div><div data-main><h1>{_S}</h1><section id="search"><h2>{_S}</h2>
    <p>{_P} {_Q}</p><p>{_Q}</p></section><section id="reviews"><h2>{_S}</h2><p>{_P}</p></section></div>
    <div class="tags"><a href=/t>{_S}</a></div></body>""",
    # the page in a form, and an article in a wrapper named after what else it holds
    f"""<body><form id="aspnetForm"><div class="menu"><a href=/>{_S}</a></div><article data-main><h1>{_S}</h1>
    <p>{_P} {_Q}</p><p>{_Q}</p></article><label>{_S}</label><div class="newsletter"><p>{_P}</p></div></form></body>""",
    f"""<body><header>{_S}</header><div class="content-sidebar-wrap"><article data-main><h1>{_S}</h1><p>{_P}</p>
    <p>{_Q} {_P}</p></article><div class="sidebar"><p>{_P}</p><ul><li><a href=/s>{_S}</a></li></ul></div></div></body>""",
)
