"""Settings of the linkers: thresholds, score weights and name tables."""

from __future__ import annotations

from dataclasses import dataclass, field


# Short forms of given names and their full names, as the decennial linker uses them (lower case).
NICKNAMES = {
    "sallie": "sarah", "sally": "sarah",
    "bettie": "elizabeth", "betty": "elizabeth", "betsy": "elizabeth", "lizzie": "elizabeth", "eliza": "elizabeth", "bess": "elizabeth",
    "polly": "mary", "mollie": "mary", "molly": "mary",
    "fannie": "frances", "fanny": "frances", "frank_f": "frances",
    "nannie": "nancy",
    "kitty": "catherine", "katie": "catherine", "kate": "catherine", "cathy": "catherine",
    "peggy": "margaret", "maggie": "margaret",
    "patsy": "martha", "mattie": "martha", "patty": "martha",
    "jennie": "jane", "jenny": "jane", "jenetta": "jane", "jeanette": "jane",
    "becky": "rebecca",
    "lou": "louisa", "louise": "louisa",
    "vicky": "victoria",
    "willie": "william", "billy": "william", "bill": "william", "will": "william",
    "jim": "james", "jimmy": "james",
    "jack": "john", "johnny": "john",
    "hank": "henry", "harry": "henry",
    "alex": "alexander", "sandy": "alexander",
    "ned": "edward", "ed": "edward", "eddie": "edward",
    "tom": "thomas", "tommy": "thomas",
    "dick": "richard",
    "bob": "robert", "bobby": "robert",
    "dan": "daniel", "danny": "daniel",
    "dave": "david",
    "gus": "augustus",
    "sam": "samuel",
    "ben": "benjamin",
    "josh": "joshua",
    "nat": "nathaniel",
    "abe": "abraham",
    "tony": "anthony",
}

# The schedule matcher's table (upper case), which is another one.
SCHEDULE_NICKNAMES = {
    "WM": "WILLIAM", "BILL": "WILLIAM", "BILLY": "WILLIAM", "WILL": "WILLIAM", "WILLY": "WILLIAM", "WILLIE": "WILLIAM",
    "ROBT": "ROBERT", "ROB": "ROBERT", "BOB": "ROBERT", "BOBBY": "ROBERT", "ROBBIE": "ROBERT",
    "JAS": "JAMES", "JIM": "JAMES", "JIMMY": "JAMES", "JAMIE": "JAMES",
    "CHAS": "CHARLES", "CHARLIE": "CHARLES", "CHUCK": "CHARLES", "CARL": "CHARLES",
    "THOS": "THOMAS", "TOM": "THOMAS", "TOMMY": "THOMAS",
    "JNO": "JOHN", "JON": "JOHN", "JACK": "JOHN", "JACKIE": "JOHN", "JONNY": "JOHN", "JOHNNY": "JOHN",
    "DAN": "DANIEL", "DANNY": "DANIEL",
    "ED": "EDWARD", "EDDIE": "EDWARD", "NED": "EDWARD", "TED": "EDWARD", "TEDDY": "EDWARD",
    "GEO": "GEORGE", "JOS": "JOSEPH", "JOE": "JOSEPH", "JOEY": "JOSEPH",
    "SAM": "SAMUEL", "SAMMY": "SAMUEL",
    "ALEX": "ALEXANDER", "ALECK": "ALEXANDER", "ALEC": "ALEXANDER", "SANDY": "ALEXANDER",
    "PAT": "PATRICK", "PADDY": "PATRICK",
    "MATT": "MATTHEW", "MAT": "MATTHEW",
    "MIKE": "MICHAEL", "MICK": "MICHAEL", "MICKEY": "MICHAEL",
    "DAVE": "DAVID", "DAVEY": "DAVID", "DAVY": "DAVID",
    "CHRIS": "CHRISTOPHER", "KIT": "CHRISTOPHER",
    "RICH": "RICHARD", "RICK": "RICHARD", "DICK": "RICHARD",
    "HARRY": "HENRY", "HAL": "HENRY", "HEN": "HENRY",
    "BEN": "BENJAMIN", "BENNY": "BENJAMIN", "BENJ": "BENJAMIN",
    "FRED": "FREDERICK", "FREDDY": "FREDERICK",
    "FRANK": "FRANCIS", "FRAN": "FRANCIS",
    "ANDY": "ANDREW", "TONY": "ANTHONY", "ART": "ARTHUR", "AL": "ALBERT",
    "WALT": "WALTER", "PETE": "PETER", "STEVE": "STEPHEN", "NICK": "NICHOLAS",
    "NAT": "NATHANIEL", "NATE": "NATHANIEL", "ABE": "ABRAHAM", "IKE": "ISAAC",
    "MARY": "MARY", "POLLY": "MARY", "MOLLIE": "MARY", "MOLLY": "MARY",
    "ELIZABETH": "ELIZABETH", "BETSY": "ELIZABETH", "BETTY": "ELIZABETH", "BETTIE": "ELIZABETH", "ELIZA": "ELIZABETH", "LIZZIE": "ELIZABETH",
    "SARAH": "SARAH", "SALLY": "SARAH", "SALLIE": "SARAH",
    "MARGARET": "MARGARET", "PEGGY": "MARGARET", "MAGGIE": "MARGARET",
    "MARTHA": "MARTHA", "PATSY": "MARTHA", "MATTIE": "MARTHA",
    "NANCY": "NANCY", "NANNIE": "NANCY", "NAN": "NANCY",
    "JANE": "JANE", "JENNIE": "JANE", "JENNY": "JANE",
    "CATHERINE": "CATHERINE", "CATHY": "CATHERINE", "KATE": "CATHERINE", "KATIE": "CATHERINE",
    "FRANCES": "FRANCES", "FANNY": "FRANCES", "FANNIE": "FRANCES",
}


@dataclass(frozen=True)
class Weights:
    intercept: float = -4.0
    exact_first: float = 4.0
    nickname: float = 3.0
    initial: float = 2.5
    given_only: float = 1.5
    male_mismatch: float = -3.0
    rare: float = 1.5
    typical: float = 1.0
    common: float = 0.5
    #: Birth years apart by 0, 1, 2, 3, up to 5, more.
    birth: tuple[float, ...] = (2.0, 1.6, 1.2, 0.7, 0.3, -1.0)
    race_agree: float = 0.5
    race_conflict: float = -1.5
    occupation: float = 0.4
    spouse: float = 1.2
    member: float = 0.6
    family_cap: float = 2.4
    neighbor: float = 0.3
    neighbor_cap: float = 0.6


@dataclass(frozen=True)
class LinkConfig:
    weights: Weights = field(default_factory=Weights)
    nicknames: dict[str, str] = field(default_factory=lambda: dict(NICKNAMES))
    #: Pairs of surnames (cleaned) known to be one.
    surname_bridges: tuple[tuple[str, str], ...] = ()
    years: tuple[int, int] = (1870, 1880)
    adjacency: int = 15
    max_household: int = 30
    rare_count: int = 3
    common_count: int = 30
    drift_quorum: int = 3
    precedence: float = 1.2
    tier1: float = 0.98
    tier2: float = 0.60
    collision_band: float = 0.05
    parent_age: tuple[int, int] = (13, 70)
    orient_age: tuple[int, int] = (13, 60)
    spouse_gap: int = 15
    child_gap: int = 13
    adult_age: int = 16
    max_birth_gap: int = 10
    max_regression: int = 2
    death_window: int = 3
    surname_window: int = 12
    given_window: int = 5
    jw: float = 0.85
    engine: str = "kinweave-decennial"
