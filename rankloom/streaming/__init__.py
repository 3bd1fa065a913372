"""The site monitor as a streaming job."""
