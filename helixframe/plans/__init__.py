"""plans of helixframe."""
