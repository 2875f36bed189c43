"""Pages made by hand in layouts of many kinds: (html, main text). 24 of PAGES came out exactly before the generator was widened by kinds that failed there; of KEPT no page changed anything."""

A = "The ferry left the harbour before dawn, and nobody on the quay was surprised that it carried only mail."
B = "By noon the wind had turned, so the captain chose the longer way around the northern island."
C = "Three passengers stayed on deck for the whole crossing and talked about the price of herring."
MENU = "<ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/s>Sport</a></li></ul>"

PAGES = [
    (A, A),
    (f"<p>{A}</p>", A),
    (f"<html><body>{A}</body></html>", A),
    (f"<html><body><p>{A}<p>{B}</body></html>", f"{A}\n{B}"),
    (f"<html><body><h1>Mail by ferry</h1>{A}<p>{B}</p></body></html>", f"Mail by ferry\n{A}\n{B}"),
    (f"<html><body><nav>{MENU}</nav><main><h1>Mail by ferry</h1><p>{A}</p><p>{B}</p></main><footer>&copy; 2021 Ferry News</footer></body></html>", f"Mail by ferry\n{A}\n{B}"),
    (f'<html><body><div class="navbar">{MENU}</div><div class="post"><h2>Mail by ferry</h2><p>{A}</p><blockquote>{B}</blockquote><p>{C}</p></div><div class="footer">Contact us by letter.</div></body></html>', f"Mail by ferry\n{A}\n{B}\n{C}"),
    (f'<html><body><header><h1>Ferry News</h1></header><article><h1>Mail by ferry</h1><p>{A}</p></article><aside class="sidebar"><h3>Popular</h3>{MENU}</aside></body></html>', f"Mail by ferry\n{A}"),
    (f'<html><body><div id="cookie-consent"><p>This site keeps cookies for statistics. Do you agree to that?</p><button>Yes</button></div><div class="k3x"><h1>Mail by ferry</h1><p>{A}</p></div></body></html>', f"Mail by ferry\n{A}"),
    (f'<html><body><div class="qz1"><div class="qz2">{MENU}</div><div class="qz3"><p>{A}</p><p>{B}</p></div><div class="qz4"><a href=/t>Terms</a> <a href=/p>Privacy</a></div></div></body></html>', f"{A}\n{B}"),
    (f"<html><body><table><tr><td>{MENU}</td><td><p>{A}</p><p>{B}</p></td></tr></table></body></html>", f"{A}\n{B}"),
    (f"<html><body><table><tr><td><a href=/>Home</a><br><a href=/b>Back</a></td><td>{A}<br><br>{B}</td></tr></table></body></html>", f"{A} {B}"),
    (f'<html><body><article><h1>Mail by ferry</h1><p>{A}</p><div class="ad">Buy two tickets and pay for one, this week only.</div><p>{B}</p></article></body></html>', f"Mail by ferry\n{A}\n{B}"),
    (f'<html><body><article><p>{A}</p><p>{B}</p></article><section class="comments"><h3>Comments</h3><div class="comment"><p>I was there that day and I can tell you that the sea was calm.</p></div></section></body></html>', f"{A}\n{B}"),
    (f'<html><body><article><p>{A}</p></article><form class="newsletter"><p>Get our letter each week, free of charge, by mail.</p><input name=m><button>Subscribe</button></form></body></html>', A),
    (f"<html><body><article><h1>Mail</h1><ul><li>{A}</li><li>{B}</li></ul><pre>depart 05:10\n  arrive 13:45</pre></article></body></html>", f"Mail\n{A}\n{B}\ndepart 05:10 arrive 13:45"),
    (f'<html><body><div class="entry-content"><p>{A}</p><h2>At noon</h2><p>{B}</p><h2>On deck</h2><p>{C}</p></div><div class="related"><h4>More</h4>{MENU}</div></body></html>', f"{A}\nAt noon\n{B}\nOn deck\n{C}"),
    (f'<html><body><section><h1>Mail by ferry</h1><p>{A} <a href="/x">Read the log of the ship</a> for more.</p><p>{B}</p></section><footer>{MENU}</footer></body></html>', f"Mail by ferry\n{A} Read the log of the ship for more.\n{B}"),
    (f'<html><body><div><div><div><p>{A}</p></div></div></div><script>var a = "<p>no</p>";</script><noscript>Please turn scripts on to see this page in full.</noscript></body></html>', A),
    (f"<html><body><center><font size=5>Mail by ferry</font></center><hr><p>{A}<p>{B}<hr><center><small>Copyright 1998</small></center></body></html>", f"Mail by ferry\n{A}\n{B}"),
    (f'<html><body><nav>{MENU}</nav><div class="x7">{A}<p>{B}</p></div><footer>&copy; Ferry</footer></body></html>', f"{A}\n{B}"),
    (f'<html><body><div class="breadcrumb"><a href=/>Home</a> &gt; <a href=/n>News</a></div><div id="story"><p>{A}</p><p>{B}</p></div><div class="share"><a href=/f>Send</a> <a href=/g>Print</a></div></body></html>', f"{A}\n{B}"),
    (f"<div><h1>Mail by ferry</h1><div>{A}</div><div>{B}</div></div>", f"Mail by ferry\n{A}\n{B}"),
    (f'<html><body><main><p>{A}</p><p>{B}</p><p>{C}</p></main><div class="popup">Join one hundred thousand readers today and get a free map.</div></body></html>', f"{A}\n{B}\n{C}"),
    (f'<html><body><div class="wrapper"><div class="header">Ferry News</div><div class="content">{A} {B}</div><div class="sidebar">Weather: fair, wind from the west, some cloud later in the day.</div></div></body></html>', f"{A} {B}"),
    (f"<html><body><p>{A} &amp; &lt;more&gt; &eacute;t&eacute;</p></body></html>", f"{A} & <more> été"),
    (f'<html><body><div class="topbar">{MENU}</div><h1>Mail by ferry</h1><p>{A}</p><p>{B}</p><p>{C}</p><div class="copyright">All rights are with the Ferry News company of the north.</div></body></html>', f"Mail by ferry\n{A}\n{B}\n{C}"),
    (f'<html><body><article class="post"><header><h1>Mail by ferry</h1></header><p>{A}</p><p>{B}</p></article></body></html>', f"Mail by ferry\n{A}\n{B}"),
    (f"<html><body><dl><dt>Morning</dt><dd>{A}</dd><dt>Noon</dt><dd>{B}</dd></dl></body></html>", f"Morning\n{A}\nNoon\n{B}"),
    (f"<html><body><nav>{MENU}</nav><footer>&copy; 2021</footer></body></html>", ""),
]

D = "Bakers in the old town start work at three, when the streets are empty and the ovens are still warm."
E = "Flour comes by cart from the mill below the bridge, two sacks at a time, as it has for a century."
G = "Rain does not keep the first customers away; they wait beneath the awning and stamp their feet."
LINKS = "<ul><li><a href=/a>Start</a></li><li><a href=/b>Shop</a></li></ul>"
KEPT = [
    (f"<body><p>{D}<br>{E}</p><p>{G}</p></body>", f"{D} {E}\n{G}"),
    (f"<html><body><div class='menu'>{LINKS}</div><article><h2>Bread</h2><p>{D}</p><aside class='ad'>Ovens on sale until Sunday, ask in the shop.</aside><p>{E}</p></article></body></html>", f"Bread\n{D}\n{E}"),
    (f"<html><body><header class='masthead'><div>Town Paper</div>{LINKS}</header><div class='story'><h1>Bread</h1><p>{D}</p><p>{E}</p><p>{G}</p></div></body></html>", f"Bread\n{D}\n{E}\n{G}"),
    (f"<html><body><div class='j1'><div class='j2'><h1>Bread</h1></div><div class='j3'><div>{D}</div><div>{E}</div><div>{G}</div></div></div></body></html>", f"Bread\n{D}\n{E}\n{G}"),
    (f"<html><body><section id='main'><h3>Bread</h3><ol><li>{D}</li><li>{E}</li></ol></section><div id='footer'>Printed in the town by hand.</div></body></html>", f"Bread\n{D}\n{E}"),
    (f"<h2>Bread</h2>{D}", f"Bread\n{D}"),
    (f"<html><body><table border=0><tr><td colspan=2><b>Town Paper</b></td></tr><tr><td>{LINKS}</td><td><h2>Bread</h2><p>{D}</p><p>{E}</p></td></tr></table></body></html>", f"Bread\n{D}\n{E}"),
    (f"<html><body><div class='alert'>Our shop moves next week to the square behind the church.</div><p>{D}</p><p>{E}</p><footer>Town Paper</footer></body></html>", f"{D}\n{E}"),
    (f"<html><body><article><p>{D}</p><p>{E}</p><div class='discussion'><p>My mother worked there for years and she says that all of it is true.</p></div></article></body></html>", f"{D}\n{E}"),
    (f"<html><body><main><figure><img src=x><figcaption>The oven in winter.</figcaption></figure><p>{D}</p><p>{G}</p></main></body></html>", f"The oven in winter.\n{D}\n{G}"),
    (f"<html><body><form id='search'><label>Find in this paper</label><input></form><div class='text'>{D}<br>{E}</div></body></html>", f"{D} {E}"),
    (f"<html><body><nav>{LINKS}</nav><div class='w1'><h1>Bread</h1><p>{D}</p><h2>Flour</h2><p>{E}</p></div><div class='sidebar'><p>Subscribe to the paper and read of bread each week.</p></div></body></html>", f"Bread\n{D}\nFlour\n{E}"),
    (f"<html><body><div class='rail'>{LINKS}</div><div class='entry'><p>{D}</p><table><tr><td>Loaf</td><td>2</td></tr></table><p>{E}</p></div></body></html>", f"{D}\nLoaf\n2\n{E}"),
    (f"<html><body><div>{D}</div><div>{E}</div><footer><p>Town Paper, by the bridge.</p></footer></body></html>", f"{D}\n{E}"),
    (f"<html><body><div class='header'>{LINKS}</div><div class='footer'>Town Paper</div></body></html>", ""),
]
