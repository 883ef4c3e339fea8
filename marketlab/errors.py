"""What the library raises."""


class MarketError(Exception):
    """Anything that the library refuses."""


class BarsError(MarketError):
    """Bars that break a rule."""


class FutureError(MarketError):
    """A look at what isn't known yet."""


class TicketError(MarketError):
    """An order that can't be taken."""


class SettingError(MarketError):
    """A parameter out of its range."""


class LedgerError(MarketError):
    """Books that don't balance."""
