"""Plans that join operators into the answers a user asks for."""
