"""Pages written by hand, each with the main text that a reader would mark."""

PAGES = [
    # a theme that names its wrapper after the sidebar, and the article's own head
    (
        """<html><head><title>x</title></head><body class="single has-sidebar"><header class="site-header"><a href="/">Daily Lake</a><p>News from the shore</p></header>
        <div class="content has-sidebar"><article class="post"><header class="entry-header"><h1>Water levels rise again</h1><span class="byline">By Ann Lee</span></header>
        <p>The lake rose by nine centimetres last week, the council said.</p><p>Roads stay open.</p><p>See <a href="/maps">the flood maps of the council and its neighbours</a></p></article></div>
        <aside class="sidebar"><h3>Popular</h3><p>Ten ways to cook perch, as told by the people who catch it.</p></aside><footer><p>Copyright Daily Lake. All rights reserved.</p></footer></body></html>""",
        "Water levels rise again\nBy Ann Lee\nThe lake rose by nine centimetres last week, the council said.\nRoads stay open.\nSee the flood maps of the council and its neighbours",
    ),
    # no semantic elements; comments and related links below
    (
        """<body><div id="topbar"><a href="/a">Home</a> <a href="/b">Forum</a></div><div id="cookie-notice"><p>We use cookies to make this site better. By reading on you agree.</p></div>
        <div class="story"><h1>How to sharpen a plane</h1><div>Start with a flat stone and plenty of water.</div><div>Hold the bevel at a steady angle.</div><div><a href="/stones">Which stones to buy</a></div>
        <div>Work until a burr shows along the whole edge.</div></div><div class="related"><ul><li><a href="/1">Fixing a chair</a></li><li><a href="/2">Oiling wood</a></li></ul></div>
        <div id="comments"><h2>Two comments</h2><div class="comment-body"><p>Great article, it helped me a lot with my old plane.</p></div></div></body>""",
        "How to sharpen a plane\nStart with a flat stone and plenty of water.\nHold the bevel at a steady angle.\nWhich stones to buy\nWork until a burr shows along the whole edge.",
    ),
    # a list inside an article that is mostly links
    (
        """<body><nav><ul><li><a href="/">Start</a></li><li><a href="/x">Topics</a></li></ul></nav><main><h1>Reading list for the winter</h1><p>Five books that we liked this year, in no order at all.</p>
        <ul><li><a href="/b1">The quiet harbour</a></li><li><a href="/b2">A field of salt</a>, a novel about a long walk home</li><li><a href="/b3">Night trains</a></li></ul><p>Write to us which ones you read.</p></main>
        <form><label>Email</label><button>Sign up</button></form></body>""",
        "Reading list for the winter\nFive books that we liked this year, in no order at all.\nThe quiet harbour\nA field of salt, a novel about a long walk home\nNight trains\nWrite to us which ones you read.",
    ),
    # a formula, a figure and an unclosed element
    (
        """<body><div role="navigation"><a href="/">Home</a></div><article><h1>Falling bodies</h1><p>The distance is <math><mi>d</mi><mo>=</mo><mi>g</mi></math> over two.<svg><text>icon</text></svg>
        <figure><figcaption>A ball and a feather</figcaption></figure><p>Both land at once.<div class="share-buttons"><a href="#">Share</a><span>Tell your friends about this</span></div></article><div class="footer">Imprint</div></body>""",
        "Falling bodies\nThe distance is d=g over two.\nA ball and a feather\nBoth land at once.",
    ),
    # an old page of tables, with navigation in a cell
    (
        """<body><table><tr><td><a href="a.html">Home</a><br><a href="b.html">Links</a><br><a href="c.html">Guestbook</a></td><td><h1>My garden diary</h1><p>In April the first beans went in.</p>
        <p>By June <a href="beans.html">the beans were taller than me and the neighbours came to look</a></p><p>Slugs ate the lettuce.</p></td></tr></table></body>""",
        "My garden diary\nIn April the first beans went in.\nBy June the beans were taller than me and the neighbours came to look\nSlugs ate the lettuce.",
    ),
    # short lines of a poem, dialog and advert around
    (
        """<body><div class="modal">Sign in to continue reading this page</div><section class="entry"><h2>Evening</h2><p>Grey</p><p>slow</p><p><a href="/r">river</a></p><p>home</p></section>
        <div class="adsbox ad">Buy two lamps and pay for one this week only.</div></body>""",
        "Evening\nGrey\nslow\nriver\nhome",
    ),
]
