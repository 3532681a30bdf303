"""DataFrame operators over packets, frames and streams."""
