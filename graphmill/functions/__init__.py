"""graphmill subpackage."""
