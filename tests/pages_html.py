"""Small listing pages, each with one trait that makes reading it hard."""

# plain rows of a table: cells without names, in an order of their own, the link in the middle
BERTHS = [("Oslo, Norway", "Dock Engineer", "Engineering"), ("Remote", "Harbour Analyst", "Data"), ("Porto, Portugal", "Crane Designer", "Design"),
          ("Ghent, Belgium", "Tide Engineer", "Engineering"), ("Remote", "Signal Engineer", "Engineering"), ("Cadiz, Spain", "Chart Analyst", "Data")]
TABLE = "<html><body><h2>Open berths</h2><table><caption>Autumn</caption><tbody>" + "".join(
    f'<tr><td>{place}<td><a href="/berth?no={k}">{role}</a><td>{team}' for k, (place, role, team) in enumerate(BERTHS, 31)
) + "</table></body></html>"

# generated class names, signs written as words, parts that a style sheet hides, a place in several pieces
ROLES = [("Roaster", 401, ["Lyon, France", "; Turin, Italy", "; Graz, Austria"]), ("Taster", 402, ["Kyoto, Japan"]), ("Packer", 403, ["Lima, Peru", "; Quito, Ecuador"])]


def _sign_card(role, number, places):
    pieces = "".join(f"<b>{p}</b>" for p in places)
    return (
        f'<article class="vB9xKe"><p><span><em aria-hidden="true">map_pin</em>{pieces}</span></p><aside class="zz0Off"><u>{places[0]}</u></aside>'
        f'<h4 class="tM3wQz">{role}</h4><footer><a href="vacancy/{number}">Details</a></footer></article>'
    )


ICONS = (
    "<html><head><style>.zz0Off{color:red;display:none}</style></head><body><main><div class='board'>"
    + "".join(_sign_card(*r) for r in ROLES) + "</div></main></body></html>"
)

# rows that open by script: no address anywhere, a number in an attribute
SHIFTS = [("Night Baker", "Remote"), ("Day Baker", "Bergen, Norway"), ("Miller", "Remote"), ("Carter", "Malmo, Sweden")]
NO_LINKS = "<html><body><dl>" + "".join(
    f'<div data-shift-id="{7300 + k}"><dt>{name}</dt><dd>{place}</dd></div>' for k, (name, place) in enumerate(SHIFTS)
) + "</dl></body></html>"


def listing(page, pages, per_page=10, total=25):
    """One page of a list of ``total`` rows, with buttons below it that turn the page."""
    shown = range((page - 1) * per_page, min(page * per_page, total))
    rows = "".join(
        f'<section class="opening"><h5><a href="/o/{k}.html">Tide Engineer {k}</a></h5><p class="where">Ghent, Belgium</p><p class="team">Engineering</p></section>'
        for k in shown
    )
    turns = "".join(f'<button name="turn">{p}</button>' for p in range(1, pages + 1))
    off = "" if page < pages else " disabled"
    return f'<html><body><div class="openings">{rows}</div><footer>{turns}<button class="onward"{off}>Further</button></footer></body></html>'


LISTING_SITE = {
    "name": "Ferry", "slug": "ferry", "start_url": "https://ferry.test/list",
    "dom": {
        "card": {"candidates": ["table.former tr", "div.openings > section.opening"]},
        "fields": {
            "title": {"selectors": ["h5 > a"]},
            "apply_url": {"selectors": ["h5 > a"], "attr": "href"},
            "location": {"selectors": ["p.absent", ":scope > p.where"]},
            "department": {"selectors": ["p.team"]},
        },
    },
    "pagination": {"type": "next", "control": {"candidates": ["button.onward"]}},
}
