"""dockcast.operators"""
